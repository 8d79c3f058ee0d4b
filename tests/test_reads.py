"""How often queries read their tables, and what they shuffle: figures that grow with the input."""

import random

import pytest

from tallyframe.operators import filings, footnotes, grids
from tallyframe.plans import queries as own
from tallyframe.plans import queries_checks, queries_filings, queries_more, queries_scores  # noqa: F401  (add their queries to own.QUERIES)

SF = "/root/testdata/sf0.001"


def total(spark, what: str) -> int:
    """A metric over all stages so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    it, n = stages.iterator(), 0
    while it.hasNext():
        n += getattr(it.next(), what)()
    return n


def test_join_is_made_once(spark, monkeypatch):
    """What the passes and steps get, and read many times, is no join of the large tables but its sums."""
    given = []
    monkeypatch.setattr(queries_more.coverage, "cover", lambda *tables: given.extend(tables))
    queries_more._covered(spark, SF)
    given += queries_checks._workbooks(spark, SF)
    plans = [x._jdf.queryExecution().optimizedPlan().toString() + x._jdf.queryExecution().executedPlan().toString() for x in given]
    assert len(plans) == 10 and not any("lineitem.parquet" in p for p in plans)


@pytest.mark.parametrize("name", ["topk_05_rank_chunks", "agg_17_idf"])
def test_texts_are_read_once(spark, name):
    """What follows the one pass over the texts reads its counts."""
    assert "documents.parquet" not in own.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString() + own.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_without_a_shuffle(spark):
    before = total(spark, "shuffleWriteRecords")
    assert own.QUERIES["agg_19_frequent_words"](spark, SF).count() > 150
    assert total(spark, "shuffleWriteRecords") - before < 100  # the count's own


def test_texts_are_normalised_once(spark):
    """The whole text, and each of its two stretches: two replacements each."""
    assert own.QUERIES["fn_s05_s06_s08_texts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 6


def _tables(rng, n):
    part = lambda rows: {"rows": rows, "full": rng.randrange(9), "listed": rng.random() < 0.1, "brackets": rng.randrange(4), "shares": rng.randrange(4), "endings": rng.random() < 0.2, "chars": rng.choice([100, 400]), "page": rng.random() < 0.3}
    return [{"number": i, "width": rng.choice([2, 3, 4, 5, 6, 9]), "first": part(rng.randrange(2, 6)), "rest": part(rng.randrange(4))} for i in range(n)]


def test_chain_of_many_tables_against_all_chains():
    def slow(tables):
        best = None
        for s, t in enumerate(tables) if len(tables) > 1 else ():
            if grids._alone(t) < grids.NO_START:
                continue
            chain, parts, width = [t["number"]], [t["first"]], t["width"]
            for n in tables[s + 1 :]:
                if abs(width - n["width"]) > grids.WIDTH_DELTA or grids._alone(n) < grids.ENDS_CHAIN or not n["rest"]["rows"]:
                    break
                chain.append(n["number"])
                parts.append(n["rest"])
                width = max(width, n["width"])
            points = grids._points(parts, width)
            if best is None or points > best[1]:
                best = (chain, points)
        return best

    rng = random.Random(7)
    for _ in range(400):
        tables = _tables(rng, rng.randrange(9))
        assert grids.best_chain(tables) == slow(tables)


def test_chain_takes_time_in_proportion(monkeypatch):
    """Numbers of a table are looked at a few times, not once for each chain that holds it."""
    looks, alone = [0], grids._points

    def counted(parts, width):
        looks[0] += len(parts)
        return alone(parts, width)

    monkeypatch.setattr(grids, "_points", counted)
    tables = [{"number": i, "width": 2, **{k: {"rows": 3, "full": 4, "listed": False, "brackets": 0, "shares": 0, "endings": False, "chars": 400, "page": False} for k in ("first", "rest")}} for i in range(500)]
    assert len(grids.best_chain(tables)[0]) == 500
    assert looks[0] < 5 * 500


def test_checks_hash_their_rows(spark):
    """Rows of a statement are hashed into its values; sorting them held all rows of a task in memory."""
    assert "SortAggregate" not in own.QUERIES["val_04_structure"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_values_are_not_dealt_out_by_concept(spark):
    """Three concepts in three tasks: each held all values of one."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        plan = own.QUERIES["join_09_val_05_rollups"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(child" not in plan and "SortMergeJoin [child" not in plan


def test_rows_of_chains_are_moved_once(spark):
    """A row of a chain or cycle is shuffled once, not in each round."""
    n, keys = 48, 60
    at = spark.range(n * keys).selectExpr(f"id div {n} as key", f"id % {n} as id")
    links = at.selectExpr("key", "id", f"case when id < {n - 1} then id + 1 when key % 2 = 0 then 0 end as next")
    before = total(spark, "shuffleWriteRecords")
    path = footnotes.follow_chains(links.selectExpr("key", "id as head", "next"), links, "key")
    rows = path.count()
    assert rows == keys // 2 * (n * n + n * (n - 1) // 2) and total(spark, "shuffleWriteRecords") - before < 2 * rows


def test_levels_of_a_tree_are_made_once(spark):
    """What is returned reads written levels; no level joins its way down from the roots again."""
    arcs = spark.createDataFrame([("r", i // 2, i, float(-i)) for i in range(2, 40)] + [("r", 39, 1, 0.0), ("r", 38, 39, 0.0)], "role string, parent long, child long, ord double")
    tree = filings.tree_rows(arcs, spark.createDataFrame([("r", 1)], "role string, node long"))
    assert "Join" not in tree._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.node, r.depth): [p.node for p in r.path] for r in tree.collect()}
    down = lambda i: [*down(i // 2), i] if i else []
    assert got == {(i, len(down(i)) - 1): down(i) for i in range(1, 40)} | {(39, 6): [*down(38), 39]}
