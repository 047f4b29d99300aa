import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioscope.llm import packing, records, tokens
from folioscope.session import fresh_path

from .conftest import odd_rows


@pytest.fixture(scope="module")
def ids():
    """Ids of the whole texts, encoded at once and not word by word."""
    whole = Tokenizer.from_file(tokens.default_tokenizer())
    return [(d, np.array(whole.encode(t or "", add_special_tokens=False).ids, "<u4")) for d, t, *_ in odd_rows()]


def test_words_give_the_ids_of_the_whole_text(monkeypatch, ids):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    monkeypatch.setattr(tokens, "STRETCH", 200)
    words = tokens.WordIds(tokens.default_tokenizer())
    made = words.encode([(t or "").encode() for _, t, *_ in odd_rows()])
    for got, (_, want) in zip(made, ids, strict=True):
        assert np.array_equal(np.frombuffer(got, words.dtype), want)


def test_packing(odd, ids, nothing):
    rows = packing.pack_documents(odd, with_ids=True).collect()
    got, places = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.start == 2048 * r.piece
        got[r.doc_id].append(r.ids)
        places[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for d, x in ids:
        full = np.append(x, np.uint32(0)).astype("<u4")
        want[d] += [full[i : i + 2048].tobytes() for i in range(0, len(full), 2048)]
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(nothing).count() == 0


def test_hierarchy_packs_like_one_group(spark):
    rng = np.random.default_rng(2)
    lengths = [int(x) for x in rng.integers(1, 2049, 900)] + [int(x) for x in rng.integers(1, 60, 900)]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "item long, length long").repartition(4)
    rows = packing.pack_items(items, group=300).collect()
    assert sorted(r.item for r in rows) == list(range(len(lengths)))
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(parts[-1]) <= 2048
    together = packing.best_fit(sorted(lengths, reverse=True), 2048)[2]
    assert len(fill) <= 1.02 * together + 2


def test_sequences_join_pieces(spark):
    rows = [(1, 0, 2, b"ab"), (1, 2, 1, b"c"), (2, 0, 1, b"d")]
    out = packing.sequences(spark.createDataFrame(rows, "sequence_id long, offset long, length long, ids binary")).collect()
    assert {r.sequence_id: (bytes(r.ids), r.length) for r in out} == {1: (b"abc", 3), 2: (b"d", 1)}


def test_best_fit_takes_the_tightest_bin():
    where, offset, bins = packing.best_fit([6, 5, 4, 5, 1], 10)
    assert (where, offset, bins) == ([0, 1, 0, 1, 2], [0, 0, 6, 5, 0], 3)


def test_records(spark, odd, ids, nothing):
    want = sorted(((d is not None, d or 0), np.append(x, np.uint32(2)).astype("<u4").tobytes()) for d, x in ids)
    rows = records.stored_documents(odd).orderBy("start").collect()
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.ids_crc32) for r in rows) == sorted(
        (k, len(b) // 4, zlib.crc32(b)) for k, b in want
    )
    order = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert order == sorted(order)
    assert records.stored_documents(nothing).count() == 0


def test_shuffled_reads_return_every_record(spark, odd, ids):
    path = records.write_records(odd, fresh_path(spark, "records"))
    records.index_records(spark, path)
    one, again, other = (records.read_shuffled(spark, path, s).collect() for s in (1, 1, 2))
    key = lambda r: (str(r.doc_id), list(r.ids))
    assert [key(r) for r in one] == [key(r) for r in again] != [key(r) for r in other]
    assert sorted(map(key, one)) == sorted(map(key, other)) == sorted((str(d), [*x.tolist(), 2]) for d, x in ids)


def test_a_damaged_frame_is_refused():
    good = records.frame(7, struct.pack("<3H", 1, 2, 3), 2) + b"\n"
    doc, found, end = records.unframe(memoryview(good), 0)
    assert (doc, found.tolist(), end) == (7, [1, 2, 3], len(good))
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises((ValueError, struct.error, IndexError)):
            records.unframe(memoryview(bytes(bad)), 0)


def test_plain_words_go_to_the_model_at_once():
    path = tokens.default_tokenizer()
    words = tokens.WordIds(path)
    whole = words.tokenizer.encode

    class Asked:
        model, seen = words.tokenizer.model, []

        def encode(self, text, **options):
            self.seen.append(text)
            return whole(text, **options)

    words.tokenizer = asked = Asked()
    text = "thonre Anblewh anblewh, istionre's \u00e9tre 12 <|endoftext|> x\u0301y."
    got = np.frombuffer(next(iter(words.encode([text.encode()]))), words.dtype).tolist()
    assert not [w for w in asked.seen if w in ("thonre", "anblewh")]
    assert got == whole(text, add_special_tokens=False).ids


def test_each_word_is_kept_once_without_its_marks():
    whole = Tokenizer.from_file(tokens.default_tokenizer())
    odd = ["İstanbul", "it's,", "<|x|>!", "étude.", "́a;", "ª,", "١٢٣", "𝒜bc?", "😀!", "ſt", "ﬁn", "Größe", "…", "a_b--", " x ", "　"]
    texts = ["word word, word. word!? größe größe; GRÖSSE...", " ".join(odd), " \n" + "\t".join(odd[::-1]) + "\x0b", "", " ", "größe " * 3]
    words = tokens.WordIds(tokens.default_tokenizer())
    for got, text in zip(words.encode([t.encode() for t in texts]), texts, strict=True):
        assert np.frombuffer(got, words.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids
    assert "word" in words.fresh and "größe" in words.fresh
    assert not {"word,", "word.", "word!?", "größe;"} & set(words.fresh)
