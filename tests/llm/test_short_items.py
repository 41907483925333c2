"""Benchmark items of fewer words than a shingle, inside longer texts."""

from quirelake.llm import decontaminate


def test_short_items_are_found_inside_texts(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven two three"), (2, "two three"), (3, "two threes and three two"), (4, ""), (5, None), (6, "a two  THREE b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Two three"), (2, "seven"), (3, "one two three four five"), (4, "four five six eight"), (5, "two three")], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.leaks(docs, bench).collect())
    pairs = [(1, 1, 1), (1, 2, 6), (1, 3, 0), (1, 5, 1), (2, 1, 0), (2, 5, 0), (6, 1, 1), (6, 5, 1)]
    assert got == [(d, i, 1.0, s, 0) for d, i, s in pairs]
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [3, 4, 5]


def test_parts_find_what_the_whole_benchmark_finds(spark, monkeypatch):
    word = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    text = lambda i: " ".join(word(100 * i + k) for k in range(3 + 2 * i))
    bench = spark.createDataFrame([*((i, text(i)) for i in range(1, 21)), (None, text(21)), (None, text(22)), (3, text(23))], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"zz yy {text(i)} xx {text(24 - i)}") for i in range(1, 24)], "doc_id long, text string")
    whole = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()), key=repr)
    assert {r[1] for r in whole} == {None, *range(1, 21)}
    for most in (2000, 700, 100):
        monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_BYTES", most)
        parts = decontaminate._parts(bench, 5, 16, 5)
        assert len(parts) > 1 and sum(len(p.ids) for p in parts) == 23
        assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect()), key=repr) == whole
