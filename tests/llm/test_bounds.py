import random
from collections import Counter, defaultdict

import pyarrow as pa

from folioscope.llm import packing, toxicity


def test_no_underfull_bin_is_closed_before_the_last_round():
    n = 5000
    table = pa.table({"length": pa.array([1500] * n, pa.int64()), "row": pa.array(range(n), pa.int64())})
    schema = "length long, row long, sequence_id long, offset long, closed boolean"
    out = packing._pack_group(0, False, 2048, schema)((pa.scalar(0),), table)
    assert len(set(out.column("sequence_id").to_pylist())) == n and not any(out.column("closed").to_pylist())


def test_surplus_bins_go_on_in_groups_of_their_own(spark):
    rng = random.Random(2)
    lengths = [rng.choice([1030, 1300, 1700, 990, 700, 340]) for _ in range(3000)]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "row long, length long").repartition(5)
    rows = packing.pack_items(items, group=300).collect()
    assert Counter((r.row, r.length) for r in rows) == Counter(enumerate(lengths))
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert end <= 2048
    assert len(places) <= 1.05 * packing.best_fit(sorted(lengths, reverse=True), 2048)[2]


def test_a_repeated_document_counts_once_in_the_fit(spark):
    rows = [(i, f"calm word number{i % 7}" + (" vile thing" if i % 5 == 0 else "")) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    chain = lambda rows: toxicity.fit_chain(
        spark.createDataFrame(rows, "doc_id long, text string"), toxicity.labelled(labels), toxicity.CHAIN
    )
    assert chain(rows + [rows[5]] * 60) == chain(rows)
