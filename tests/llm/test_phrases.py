import random
import re
from collections import Counter, defaultdict

from folioscope.llm import phrases


def brute(rows, least=30, covered=80, reported=2000):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    count[lang][tuple(words[i : i + k])] += 1
    out = set()
    for lang, f in count.items():
        often = {g: c for g, c in f.items() if c >= least and len(g) > 1}
        hidden = set()
        for g, c in often.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    if 100 * c >= covered * f[g[i : i + m]]:
                        hidden.add(g[i : i + m])
        scored = []
        for g, a in often.items():
            if g in hidden:
                continue
            cuts = [(2000000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g))]
            score, _, l, r = min(cuts)
            scored.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, g, l, r) in enumerate(sorted(scored)[:reported], 1):
            out.add((lang, rank, g.decode(), -a, l, r, total[lang], -score))
    return out


def made_rows():
    rng = random.Random(3)
    vocab = ["The", "of", "and", "new", "york", "city", "naïve", "\x01x", "a\x01", "a", "été", "|", "<b>", "Ünder"]
    rows = []
    for n in range(300):
        words = []
        for _ in range(rng.randint(1, 60)):
            words += rng.choice([["New", "York", "City"], ["the", "a", "of"], [rng.choice(vocab)], [rng.choice(vocab)], ["solo%d" % rng.randrange(900)]])
        text = "".join(w + rng.choice([" ", " ", " ", " ", "\t", ". ", ",", "\n", "  ", " ", " - "]) for w in words)
        rows.append((text, rng.choice(["en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), (" .,", "de"), ("one two three " * 20_000, "fr"), (".".join(["dots here"] * 40), "fr")]


def result(df):
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


def test_collocations_equal_brute_force(spark, monkeypatch):
    rows = made_rows()
    docs = spark.createDataFrame([(t, l, 1, "g") for t, l in rows], "text string, lang string, c long, gram string").repartition(3)
    expected = brute(rows)
    assert len(expected) > 100
    assert result(phrases.collocations(docs)) == expected
    # Counts sent on after few words, and long texts cut at marks, change nothing.
    monkeypatch.setattr(phrases, "LEAST_BITS", 64)
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    assert result(phrases.collocations(docs, covered=50, reported=7)) == brute(rows, covered=50, reported=7)


def test_long_texts_are_cut_at_marks_only():
    text = b"aa bb. cc dd, ee" * 10 + b"x" * 200 + b". end"
    old, phrases.STRETCH = phrases.STRETCH, 20
    try:
        parts = list(phrases._stretches(text.translate(phrases._PLAIN)))
    finally:
        phrases.STRETCH = old
    assert len(parts) > 5 and b"".join(parts) == text.translate(phrases._PLAIN)
    assert all(p.startswith(b".") for p in parts[1:])


def test_runs_are_added_up(spark, monkeypatch):
    rows = [("one two three four five", "en")] * 40 + [("one two", "en")] * 5
    got = list(phrases._counter(1, [])(iter([_batch(rows)])))
    monkeypatch.setattr(phrases, "HELD", 4)
    more = list(phrases._counter(1, [])(iter([_batch(rows)])))
    add = lambda bs: sum((Counter(dict(zip(b["gram"].to_pylist(), b["c"].to_pylist()))) for b in bs), Counter())
    assert len(more) > len(got) and add(more) == add(got)


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([l for _, l in rows]), pa.array([t for t, _ in rows])], names=["lang", "text"])


def test_no_rows(spark, nothing):
    assert phrases.collocations(nothing).count() == 0


def test_odd_rows(spark, odd):
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert result(phrases.collocations(odd)) == brute(rows)
