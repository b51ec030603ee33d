import random

import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.operators import relate, tag_blocks
from millrace.operators.relate import similar_sets_many


def _by_hand(asked, stored, k, exclude):
    out = []
    for q, wanted in asked:
        wanted = set(wanted or []) - {None}
        scores = []
        for r, tags in stored:
            tags = set(tags or []) - {None}
            if wanted & tags and not (exclude and r == q):
                scores.append((-len(wanted & tags) / len(wanted | tags), r))
        out += [(q, i + 1, r, -s) for i, (s, r) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("k,rounds,exclude", [(1, (60, 30, 15), False), (3, (80, 50), True), (3, (), True), (50, (100, 1), False)])
def test_against_all_pairs(spark, k, rounds, exclude):
    random.seed(k)
    tags = [f"t{int(random.paretovariate(0.6)) % 60}" for _ in range(400)]
    stored = [(i, random.sample(tags, random.choice([1, 3, 8, 20]))) for i in range(120)]
    stored += [(200 + i, stored[i][1]) for i in range(10)] + [(300, []), (301, None), (302, [None, "t1", "t1"])]
    asked = stored[::6] + [(900, ["unknown"]), (901, ["unknown", "t1"])]
    schema = "id int, tags array<string>"
    left, right = spark.createDataFrame(asked, schema), spark.createDataFrame(stored, schema).repartition(3)
    got = similar_sets_many(left, right, "id", "tags", k, exclude, rounds)
    assert got.columns == ["query_id", "rank", "id", "score"]
    assert rows(got) == _by_hand(asked, stored, k, exclude)


def test_empty_tables_and_clashing_names(spark):
    full = spark.createDataFrame([(1, ["a"], "x", 7)], "id int, tag array<string>, row string, size int")
    assert rows(similar_sets_many(full, full, "id", "tag")) == [(1, 1, 1, 1.0)]
    assert similar_sets_many(full.limit(0), full, "id", "tag").collect() == []
    assert similar_sets_many(full, full.limit(0), "id", "tag").collect() == []
    with pytest.raises(ValueError):
        similar_sets_many(full, full, "id", "tag", k=0)


def test_alike_sets_are_not_written_as_pairs(spark, monkeypatch):
    table = spark.createDataFrame([(i, ["a", "b", "c", f"t{i % 7}"]) for i in range(300)], "id int, tags array<string>").repartition(3)
    written, materialize = [], relate.materialize

    def counted(df):
        out = materialize(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(relate, "materialize", counted)
    got = similar_sets_many(table, table, "id", "tags", 2, True)
    assert rows(got) == _by_hand(*2 * [[tuple(r) for r in table.collect()]], 2, True)
    assert max(written) <= 300 * 2 * 8
    assert "Generate explode" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("limit", ["BLOCK_ROWS", "BLOCK_TAGS", "BLOCK_BEST"])
def test_many_blocks_of_queries(spark, monkeypatch, limit):
    random.seed(3)
    monkeypatch.setattr(relate, limit, 40)
    table = [(i, random.sample([f"t{i}" for i in range(30)], random.choice([1, 5, 12]))) for i in range(60)]
    df = spark.createDataFrame(table, "id int, tags array<string>").repartition(4)
    assert rows(similar_sets_many(df, df, "id", "tags", 4, True)) == _by_hand(table, table, 4, True)


@pytest.mark.parametrize("limits", [{}, {"STRIPE": 7, "SLICE_ROWS": 5}, {"SLICE_TAGS": 20, "HITS": 3, "COLUMNS": 2}, {"COLUMNS": 0}])
@pytest.mark.parametrize("k,rounds", [(1, (90, 50, 20)), (4, ()), (300, (60,))])
def test_slices_and_stripes(monkeypatch, limits, k, rounds):
    for name, value in limits.items():
        monkeypatch.setattr(tag_blocks, name, value)
    random.seed(k)
    stored = [(i, random.sample(range(40), random.choice([1, 2, 9, 30]))) for i in range(90)]
    asked = stored[::4] + [(900, [77])]
    kind = pa.list_(pa.int32())

    def table(sets):
        return pa.table({"q": [i for i, _ in sets], "key": [i for i, _ in sets], "set": pa.array([s for _, s in sets], kind)})

    block = tag_blocks.Block(table(asked), True)
    best, seen = tag_blocks.Best(block, k, rounds), 0
    for batch in table(stored).to_batches(max_chunksize=37):
        for first, *rest in block.slices(batch):
            best.see(seen + first, *rest)
        seen += len(batch)
    got = sorted((q, -s, r) for q, r, s in zip(*(x.tolist() for x in best.found()), strict=True))
    assert got == [(q, -s, r) for q, _, r, s in _by_hand(asked, stored, k, True)]


def _best_by_kernel(asked, stored, k, rounds=(60, 20)):
    def table(sets):
        kind = pa.list_(pa.int32())
        return pa.table({"q": [i for i, _ in sets], "key": [i for i, _ in sets], "set": pa.array([s for _, s in sets], kind)})

    block = tag_blocks.Block(table(asked), True)
    best, seen = tag_blocks.Best(block, k, rounds), 0
    for batch in table(stored).to_batches(max_chunksize=70):
        for first, *rest in block.slices(batch):
            best.see(seen + first, *rest)
        seen += len(batch)
    return block, sorted((q, -s, r) for q, r, s in zip(*(x.tolist() for x in best.found()), strict=True))


@pytest.mark.parametrize("batch", [1, 64 * 5, 1 << 19])
def test_kinds_of_sets_meet_in_their_own_stripes(monkeypatch, batch):
    for name, value in {"KINDS": 3, "KIND_ROWS": 10, "STRIPE": 20, "BATCH": batch}.items():
        monkeypatch.setattr(tag_blocks, name, value)
    random.seed(batch)
    words = [range(100 * kind, 100 * kind + 40) for kind in range(3)]
    stored = [(i, random.sample(words[i % 3], random.choice([5, 12, 30])) + random.sample(range(900, 940), i % 2)) for i in range(180)]
    asked = stored[::2]
    block, got = _best_by_kernel(asked, stored, 4)
    assert got == [(q, -s, r) for q, _, r, s in _by_hand(asked, stored, 4, True)]
    for stripe in block.stripes:
        assert len({int(q) % 3 for q in block.q[stripe.first : stripe.first + len(stripe.size)]}) == 1


@pytest.mark.parametrize("share", [1, 2, 10])
def test_counts_beyond_a_byte(monkeypatch, share):
    monkeypatch.setattr(tag_blocks, "COLUMN_SHARE", share)
    random.seed(share)
    stored = [(i, random.sample(range(900), random.choice([1, 250, 300, 800]))) for i in range(40)] + [(40 + i, [*range(600)]) for i in range(5)]
    _, got = _best_by_kernel(stored, stored, 3)
    assert got == [(q, -s, r) for q, _, r, s in _by_hand(stored, stored, 3, True)]


def test_sets_are_made_once_and_compared_as_numbers(spark, monkeypatch):
    text = spark.createDataFrame([(i, f"a b t{i % 5} u{i}") for i in range(40)], "id int, text string")
    path = relate.materialize(text)
    tagged = path.select("id", F.regexp_extract_all("text", F.lit("[a-z0-9]+"), F.lit(0)).alias("tags"))
    made, types, materialize, best_of_block = [], [], relate.materialize, relate._best_of_block

    def counted(df):
        made.append(df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all("))
        return materialize(df)

    def typed(asked, stored, *rest):
        types.extend(df.schema["set"].dataType.elementType.simpleString() for df in (asked, stored))
        return best_of_block(asked, stored, *rest)

    monkeypatch.setattr(relate, "materialize", counted)
    monkeypatch.setattr(relate, "_best_of_block", typed)
    monkeypatch.setattr(relate, "LOOKUP", 7)
    got = similar_sets_many(tagged.where("id % 4 = 0"), tagged, "id", "tags", 3, True)
    table = [(r.id, r.text.split()) for r in text.collect()]
    assert rows(got) == _by_hand(table[::4], table, 3, True)
    assert sorted(made)[-2:] == [1, 1] and sum(made) == 2
    assert set(types) == {"int"}


@pytest.mark.parametrize("schema,ids", [
    ("id int, tags array<string>", [None, None, 1]),
    ("id date, tags array<string>", ["2020-01-03", "2020-01-02", "2020-01-01"]),
    ("id struct<a: int, b: string>, tags array<string>", ["2,x", "1,y", "1,x"]),
])
def test_ids_of_any_type(spark, schema, ids):
    text = spark.createDataFrame([(i, [t, "u"]) for i, t in zip(ids, "abc", strict=True)], "id string, tags array<string>")
    kind = schema.split(",")[0].removeprefix("id ")
    if "struct" in schema:
        df = text.selectExpr("from_csv(id, 'a int, b string') AS id", "tags")
    else:
        df = text.selectExpr(f"cast(id AS {kind}) AS id", "tags")
    got = similar_sets_many(df, df, "id", "tags", 5, True).selectExpr("cast(query_id AS string)", "rank", "cast(id AS string)", "score")
    shown = [r[0] for r in df.selectExpr("cast(id AS string)").collect()]
    expected = []
    for q in shown:
        others = sorted((r for r in shown if r != q), key=lambda r: (r is not None, r))
        expected += [(q, i + 1, r, 1 / 3) for i, r in enumerate(others)]
    assert rows(got) == sorted(expected, key=lambda r: [(v is not None, v if v is not None else 0) for v in r])


def test_tags_of_two_types(spark):
    asked = spark.createDataFrame([(1, [1, 2])], "id int, tags array<int>")
    stored = spark.createDataFrame([(1, [1, 2, 3]), (2, [2 + (1 << 32)]), (3, [2])], "id bigint, tags array<bigint>")
    assert rows(similar_sets_many(asked, stored, "id", "tags", 5, True)) == [(1, 1, 3, 0.5)]
    zeros = spark.createDataFrame([(1, [0.0, 1.0])], "id int, tags array<double>")
    minus = spark.createDataFrame([(2, [-0.0, float("nan")])], "id int, tags array<double>")
    assert rows(similar_sets_many(zeros, minus, "id", "tags")) == [(1, 1, 2, 1 / 3)]
