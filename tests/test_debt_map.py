"""The debt map: party names, ids that stay, and runs that are stopped and taken up again."""

from pyspark.sql import functions as F

from tallyframe.operators import debt_map as dm
from tallyframe.session import new_path

DOCS = "job string, pos long, form string, file string, text string"
TEXT = 'Issuer: Acmé Corp.\nISSUER :  "ACME CORP"\nGuarantors： Beta L.L.C.\nParent: [redacted]\nCompany: X\n\nthe Borrower means “Gamma Funding, Inc.” and Guarantor means \'Beta LLC\'\n- Delta Receivables LLC (NV)\nDelta Receivables LLC (NV)\n'


def docs(spark):
    rows = [("a", 0, "8-K", "ex-10.htm", "this credit agreement\n" + TEXT), ("a", 1, "8-K", "ex-4.htm", "Indenture\nIssuer: Beta LLC\nCo-Issuers: Epsilon plc"), ("a", 2, "10-K", "main.htm", "our debt " + TEXT), ("a", 3, "8-K", "x.htm", None), ("b", 0, "8-K", "ex-10.htm", "a credit agreement\nBorrower: Beta, Inc.")]
    return spark.createDataFrame(rows, DOCS).withColumn("id", F.lit("clash"))


def test_entity_hints(spark):
    rows = [("a", 0, "credit_agreement", TEXT), ("a", 1, "other", TEXT), ("a", 2, "other", None), ("a", 3, "indenture", "")]
    out = dm.entity_hints(spark.createDataFrame(rows, "job string, pos long, class string, text string")).orderBy("pos", "n").collect()
    first = [("Acmé Corp.", "acme", "issuer", "issuer", 88), ("Beta L.L.C.", "beta", "guarantor", "subsidiary_guarantor", 88), ("Gamma Funding, Inc.", "gamma funding", "borrower", "borrower", 84), ("Beta LLC", "beta", "guarantor", "subsidiary_guarantor", 84)]
    got = [(r.legal_name, r.normal, r.kind, r.role, r.points) for r in out if r.pos == 1]
    assert got == first
    more = [(r.legal_name, r.kind, r.points) for r in out if r.pos == 0][4:]
    assert more == [("the Borrower means “Gamma Funding, Inc.” and Guarantor means 'Beta LLC'", "finance_subsidiary", 50), ("Delta Receivables LLC (NV)", "finance_subsidiary", 50)]


def test_stopped_runs_go_on_and_ids_stay(spark):
    whole, parts = dm.DebtMapJob(spark, new_path(spark, "map")), dm.DebtMapJob(spark, new_path(spark, "map"))
    registrants = spark.createDataFrame([("a", "Big Holdings"), ("b", "Other")], "job string, company string")
    once = sorted(map(tuple, whole.run("r1", docs(spark), registrants).collect()))
    assert once == [("a", 4, 3, 7, 8, "complete"), ("b", 1, 1, 2, 1, "complete")]
    for stage in dm.DebtMapJob.STAGES[:-1]:  # stopped after each stage; what is done isn't made again, whatever comes in
        assert parts.run("r1", docs(spark) if stage == "classified" else docs(spark).limit(0), registrants, stop_after=stage) is None
        assert parts.done("r1")[-1] == stage
    assert sorted(map(tuple, parts.run("r1", docs(spark).limit(0), registrants).collect())) == once
    ids = lambda job, run: {(r.job, r.normal): r.id for r in job.table(run, "entities").collect()}
    assert ids(parts, "r1") == ids(whole, "r1") and ids(whole, "r1")["a", "big holdings"] == 1
    assert sorted(v for (j, _), v in ids(whole, "r1").items() if j == "a") == [1, 2, 3, 4, 5, 6, 7]
    # a table that was broken off has no mark of success and is made again
    spark.read.parquet(whole._at("r1/roles")).limit(0).write.mode("overwrite").parquet(whole._at("r3/roles"))
    fs = spark._jvm.org.apache.hadoop.fs.Path(whole._at("r3/roles/_SUCCESS"))
    fs.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs, False)
    assert whole.done("r3") == []
    # another run sees other names first; known names keep their ids, new ones follow
    later = docs(spark).where("pos = 1").unionByName(spark.createDataFrame([("a", 0, "8-K", "ex-10.htm", "credit agreement\nIssuer: Zeta SA", "x")], DOCS + ", id string"))
    whole.run("r2", later, registrants)
    again = ids(whole, "r2")
    assert all(ids(whole, "r1")[k] == v for k, v in again.items() if k in ids(whole, "r1")) and again["a", "zeta sa"] == 8
    whole.run("r4", docs(spark), registrants)
    assert ids(whole, "r4") == ids(whole, "r1")
