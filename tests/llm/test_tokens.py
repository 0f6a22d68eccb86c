import random
import zlib

import numpy as np
import pytest

from tests.llm.helpers import awkward, cluttered, nothing
from tillmark.llm import pieces, token_files
from tillmark.llm.common import tokenizer_path

BPE, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def texts():
    rng = random.Random(3)
    parts = ["the", "Élan", "über", "don't", "it's", "x1y2", "foo,bar", "  ", "\n", "\t", " \n", "東京", "नमस्ते", "🙂", "…", " ", "a\nb", "",
             "word.", "(see", "end).\nNext", "ABC!!", "x" * 40, "<|endoftext|>", "▁", " ", "'s", "ß"]
    return ["", " ", "a", " a", "a ", "\n", "a\n \nb", "a \nb"] + [" ".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(300)]


def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_cached_pieces_equal_whole_texts():
    reference, cache = reference_tokenizer(), token_files.PieceCache(BPE, limit=50)
    some = texts()
    for begin in range(0, len(some), 40):
        for text, blob in zip(some[begin : begin + 40], cache.encode(some[begin : begin + 40]), strict=True):
            assert np.frombuffer(blob, "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)


def test_perfect_hash_finds_its_keys_and_refuses_others():
    for n in (1, 2, 7, 1000):
        keys = token_files.keys_of(list(range(0, 3 * n, 3)), [0] * n)
        displacement, slot = token_files.perfect_hash(keys)
        assert sorted(slot.tolist()) == list(range(n))
        slots = np.zeros(n, token_files.SLOT)
        slots["fingerprint"][slot] = token_files.fingerprints(keys)
        assert token_files.find(keys, displacement, slots).tolist() == slot.tolist()
        others = token_files.keys_of(list(range(1, 3 * n, 3)), [0] * n)
        assert (token_files.find(others, displacement, slots) == -1).all()


def test_perfect_hash_tries_displacements_together(monkeypatch):
    calls, plain = [], token_files.mix
    monkeypatch.setattr(token_files, "mix", lambda x, seed: calls.append(seed) or plain(x, seed))
    displacement, slot = token_files.perfect_hash(token_files.keys_of(list(range(3000)), [0] * 3000))
    assert sorted(slot.tolist()) == list(range(3000)) and displacement.max() > 16
    assert len(calls) < 1000  # one or more for each try of each bucket before


def test_full_cache_keeps_what_is_in_use():
    cache, sent = token_files.PieceCache(BPE, limit=3), []
    first, encoded = cache.encode(["x one two three four"]), cache.ids
    assert len(cache.pieces) > cache.limit
    cache.ids = lambda texts: sent.extend(texts) or encoded(texts)
    assert cache.encode(["x one two three four"]) == first
    assert sent == ["x"]  # no piece is encoded again
    cache.encode(["x four"])
    assert set(cache.pieces) == {"x", "four"}


@pytest.mark.parametrize("docs_per_shard", [4096, 3])
def test_files_read_back(spark, docs_per_shard):
    docs = cluttered(awkward(spark))
    path = token_files.write_tokens(docs, BPE, shard_docs=docs_per_shard, shard_tokens=1 << 12)
    got = sorted((tuple(r) for r in token_files.read_documents(spark, path).collect()), key=lambda r: r[1])
    reference, start = reference_tokenizer(), 0
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r))
    assert len(got) == len(rows)
    for (doc, text), row in zip(rows, got, strict=True):
        ids = reference.encode(text, add_special_tokens=False).ids + [0]
        assert row == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.lookup(spark, path, 8) == reference.encode("x", add_special_tokens=False).ids + [0]
    assert token_files.lookup(spark, path, 4, occurrence=1) == token_files.lookup(spark, path, 4)
    assert token_files.lookup(spark, path, 4, occurrence=2) is None
    assert token_files.lookup(spark, path, 77) is None


def test_empty_tables(spark):
    path = token_files.write_tokens(nothing(spark), BPE)
    assert token_files.read_documents(spark, path).count() == 0
    assert pieces.encode_pieces(nothing(spark), PIECES, decoded="decoded").count() == 0


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PIECES)


def test_best_split_equals_brute_force(model):
    """Dynamic programming over strings instead of the trie and the batches."""
    table = {model.bytes_of[i].decode("utf-8", "replace"): i for i in range(len(model.scores))
             if model.trie.value.size and pieces.MARKER not in model.bytes_of[i].decode("utf-8", "replace")[1:] and len(model.bytes_of[i]) and i not in set(model.byte_ids.tolist())}

    def brute(word):
        best = [(0.0, [])] + [None] * len(word)
        for end in range(1, len(word) + 1):
            for begin in range(max(0, end - 48), end):
                if best[begin] is None:
                    continue
                part = word[begin:end]
                if part in table:
                    option = (best[begin][0] + model.scores[table[part]], best[begin][1] + [table[part]])
                elif len(part) == 1:
                    option = (best[begin][0] + model.unknown, best[begin][1] + [int(model.byte_ids[b]) for b in part.encode()])
                else:
                    continue
                if best[end] is None or option[0] > best[end][0]:
                    best[end] = option
        return best[-1][1]

    words = [pieces.MARKER + w for w in ("hello", "tokenization", "Élan", "über", "x1y2", "東京", "🙂🙂a", "", "zzzzqqq", "foo.\nBar", "thandnd" * 9)]
    got = model.solve([w.encode() for w in words])
    assert [np.frombuffer(b, "<i4").tolist() for b in got] == [brute(w) for w in words]


def test_runs_of_spaces_get_their_best_split(model):
    """Whole texts by dynamic programming over strings, with every normal piece of the model file."""
    import sentencepiece

    source = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table = {source.id_to_piece(i): i for i in range(source.get_piece_size())
             if not (source.is_byte(i) or source.is_control(i) or source.is_unknown(i) or source.is_unused(i))}
    longest = max(map(len, table))

    def brute(text):
        marked = pieces.MARKER + text.replace(" ", pieces.MARKER)
        best = [(0.0, [])] + [None] * len(marked)
        for end in range(1, len(marked) + 1):
            for begin in range(max(0, end - longest), end):
                part = marked[begin:end]
                if part in table:
                    option = (best[begin][0] + source.get_score(table[part]), best[begin][1] + [table[part]])
                elif len(part) == 1:
                    option = (best[begin][0] + model.unknown, best[begin][1] + [int(model.byte_ids[b]) for b in part.encode()])
                else:
                    continue
                if best[end] is None or option[0] > best[end][0]:
                    best[end] = option
        return best[-1][1]

    some = [f"a{' ' * n}b" for n in range(1, 41)] + [f"x\n{' ' * n}東京{' ' * (40 - n)}end" for n in range(3, 38, 5)]
    some += [" " * n for n in range(1, 41)] + [f"{' ' * n}x = 1{' ' * n}" for n in range(3, 41, 6)] + ["a▁▁▁ ▁b", "▁▁▁"]
    for text, blob in zip(some, pieces.Encoder(model).encode(some), strict=True):
        ids = np.frombuffer(blob, "<i4")
        assert ids.tolist() == brute(text), repr(text)
        assert model.decode(ids) == text.replace(pieces.MARKER, " ")
    assert [source.id_to_piece(i) for i in brute("a   b")] == ["▁a", "▁▁", "▁b"]


def test_a_worker_keeps_few_parts_between_tasks(model):
    encoder = pieces.Encoder(model, limit=8, kept=3)
    first = encoder.encode(["a b c d e f g h i j"])
    assert len(encoder.solved) == 10
    assert encoder.encode(["a b c d e f g h i j"]) == first
    encoder.trim()
    assert len(encoder.solved) == 3


def test_equals_the_library_as_a_unigram_model(model):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:  # the extreme score of marker runs would drown single precision
        piece.score = max(piece.score, -40_000.0 * len(piece.piece))
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    encoder = pieces.Encoder(model)
    some = ["hello world", "The quick brown fox jumps over it.", "Élan vital über alles", "don't stop", "a  b", "tokenization 12345"]
    for text, blob in zip(some, encoder.encode(some), strict=True):
        assert np.frombuffer(blob, "<i4").tolist() == library.encode(text), text


def test_round_trip_of_awkward_rows(spark):
    docs = cluttered(awkward(spark))
    out = pieces.encode_pieces(docs, PIECES, decoded="decoded")
    assert out.columns == [*docs.columns, "token_ids", "decoded"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert row["decoded"] == row["text"]
        assert (row["token_ids"] is None) == (row["text"] is None)
    again = pieces.decode_pieces(out.drop("decoded"), PIECES, text="back").where("NOT (back <=> text)")
    assert again.count() == 0
    with pytest.raises(ValueError):
        pieces.encode_pieces(out, PIECES)


def test_every_text_survives_decoding(model):
    some = [t for t in texts() if pieces.MARKER not in t]
    for text, blob in zip(some, pieces.Encoder(model, limit=20).encode(some), strict=True):
        assert model.decode(np.frombuffer(blob, "<i4")) == text
