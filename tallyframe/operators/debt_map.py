"""The debt map of issuers: documents to classes, instruments, entities and their roles, in stages that can be resumed.

Each stage's result is a table under the job's folder, and a line of the status table says that it is done. A run goes
on after the last stage that is done, so a run that was stopped repeats one stage at most. Entities keep the ids that
they got when they were first seen, in this run or one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import classes
from tallyframe.functions import text as tx
from tallyframe.functions.keep import keep_first

# fixed values: party labels and the role that each names, the first that the label starts with
ROLES = [("co-issuer", "co_issuer"), ("issuer", "issuer"), ("borrower", "borrower"), ("company", "borrower"), ("parent", "parent_guarantor"), ("guarantor", "subsidiary_guarantor")]
KINDS = {"issuer": "issuer", "co_issuer": "issuer", "borrower": "borrower", "parent_guarantor": "guarantor", "subsidiary_guarantor": "guarantor"}
PARTY_LINE = r"(?i)^(issuer|issuers|company|borrower|borrowers|parent|guarantor|guarantors|co-issuer|co-issuers)\s*[:：]\s*(.+)$"
DEFINITION = r"(?i)\b(Issuer|Issuers|Borrower|Borrowers|Company|Parent|Guarantors?)\s+means\s+[\"“']([^\"”']{4,240})[\"”']"
FINANCE_LINE = r"(?i)\b(Funding|Finance|Receivables|Securitization)\b.*\b(LLC|L\.L\.C\.|Inc\.?|Corp\.?|LP|L\.P\.)\b"
LEGAL_FORMS = r"(?i)\b(llc|l\.l\.c\.|inc\.?|corp\.?|ltd\.?|lp|l\.p\.|plc|co\.?)\b"
CONTRACTS = ["indenture", "credit_agreement", "security_or_guarantee"]
DEBTISH = ["indenture", "credit_agreement", "security_or_guarantee", "prospectus", "exhibit_21", "exhibit_22"]
DEBT_WORDS, PERIODIC_WORDS = r"(?i)indenture|credit agreement|guarantee|senior notes|term loan|revolving credit", r"(?i)debt|borrowings|credit facility|long-term|outstanding.*debt"
# fixed values: characters in which each is looked for
PARTY_CHARS, DEFINITION_CHARS, FINANCE_CHARS, DEBT_CHARS, PERIODIC_CHARS = 5000, 25_000, 20_000, 6000, 12_000


def party_name(raw: Column) -> Column:
    """A name as it is matched: lower case, without marks, punctuation and legal forms."""
    plain = F.regexp_replace(tx.plain_letters(F.lower(raw)), "[,.'\"]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, LEGAL_FORMS, ""), r"\s+", " "))


def _clean(name: Column) -> Column:
    """A name without quotes at its ends; null for names of under 3 or over 280 characters and for blanked ones."""
    t = F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), "^[\"“]+|[\"”]+$", "")
    return F.when(F.length(t).between(3, 280) & ~F.lower(t).rlike(r"xxxx|redacted|\[.*\]"), t)


def _role(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for start, role in reversed(ROLES):
        out = F.when(F.lower(label).startswith(start), role).otherwise(out)
    return out


def entity_hints(documents: DataFrame, party_points: int = 88, definition_points: int = 84, keyword_points: int = 50) -> DataFrame:
    """Names of parties in documents (job, pos, class, text): job, pos, n (order in the document), legal_name, normal,
    kind, role, points. Lines "Issuer: X" of the text's beginning, then definitions "Borrower means "X"", each role and
    name once by either way; then, in contracts, lines that read like a finance company's name. Null texts have none."""
    text = lambda n: F.substring(F.coalesce("text", F.lit("")), 1, n)
    entry = lambda way, points, label, name: F.struct(F.lit(way).alias("way"), F.lit(points).alias("points"), _role(label).alias("role"), _clean(name).alias("name"))
    lines = F.filter(F.transform(F.split(text(PARTY_CHARS), r"\n+"), lambda x: F.trim(x)), lambda x: x.rlike(PARTY_LINE))
    parties = F.transform(lines, lambda x: entry(0, party_points, F.regexp_extract(x, PARTY_LINE, 1), F.regexp_extract(x, PARTY_LINE, 2)))
    defined = F.transform(F.regexp_extract_all(text(DEFINITION_CHARS), F.lit(DEFINITION), F.lit(0)), lambda x: entry(1, definition_points, F.regexp_extract(x, DEFINITION, 1), F.regexp_extract(x, DEFINITION, 2)))
    financing = F.filter(F.transform(F.filter(F.split(text(FINANCE_CHARS), r"\n"), lambda x: x.rlike(FINANCE_LINE)), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[^A-Za-z0-9(]+", ""), r"\s+", " "))), lambda t: F.length(t).between(9, 219))
    finance = F.transform(F.slice(F.array_distinct(financing), 1, 20), lambda t: F.struct(F.lit(2).alias("way"), F.lit(keyword_points).alias("points"), F.lit("borrower").alias("role"), t.alias("name")))
    all_ = F.concat(parties, defined, F.when(F.col("class").isin(*CONTRACTS), finance).otherwise(F.slice(finance, 1, 0)))
    rows = documents.select("job", "pos", F.posexplode(all_).alias("n", "h")).select("job", "pos", "n", "h.*").where("role is not null and name is not null").withColumn("normal", party_name(F.col("name")))
    kind = F.when(F.col("way") == 2, "finance_subsidiary").otherwise(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("role")))
    first = keep_first(rows, ["job", "pos", "way", "role", "normal"], ["n"])
    return first.select("job", "pos", "n", F.col("name").alias("legal_name"), "normal", kind.alias("kind"), "role", "points")


def with_ids(seen: DataFrame, known: DataFrame) -> DataFrame:
    """The first row of each (job, normal) of seen (pos, n: order), with its id: the one of known (job, normal, id), else
    the next free number of its job, in the order in which names were seen. Only new names are numbered."""
    first = keep_first(seen, ["job", "normal"], ["pos", "n"])
    joined = first.join(known.select("job", "normal", "id"), ["job", "normal"], "left")
    most = known.groupBy("job").agg(F.max("id").alias("most"))
    fresh = joined.where("id is null").join(most, "job", "left").withColumn("id", F.coalesce("most", F.lit(0)) + F.row_number().over(Window.partitionBy("job").orderBy("pos", "n", "normal"))).drop("most")
    return joined.where("id is not null").unionByName(fresh.withColumn("id", F.col("id").cast("long")))


class DebtMapJob:
    """A job's stages in a folder: classified, hints, entities, roles, counts, in this order."""

    STAGES = ["classified", "hints", "entities", "roles", "counts"]

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name) + "/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def done(self, run: str) -> list[str]:
        """The stages of a run that are done: those whose tables were written whole."""
        return [s for s in self.STAGES if self._exists(f"{run}/{s}")]

    def table(self, run: str, stage: str) -> DataFrame:
        return self.spark.read.parquet(self._at(f"{run}/{stage}"))

    def _known(self) -> DataFrame:
        """Entities of all finished runs."""
        if self._exists("entities"):
            return self.spark.read.parquet(self._at("entities"))
        return self.spark.createDataFrame([], "job string, normal string, id long, legal_name string, kind string")

    def run(self, run: str, documents: DataFrame, registrants: DataFrame, stop_after: str | None = None) -> DataFrame | None:
        """Runs the stages of a run that aren't done yet and returns its counts; None when it stopped after stop_after.

        documents: job, pos (order of filings), form, file, text. registrants: job, company (gets the job's first id).
        The same run's tables are read, never made anew; another run starts from its documents and from the entities of
        finished runs."""
        makers = {"classified": lambda: self._classified(documents), "hints": lambda: entity_hints(self.table(run, "classified")), "entities": lambda: self._entities(run, registrants), "roles": lambda: self._roles(run), "counts": lambda: self._counts(run)}
        done = self.done(run)
        for stage in self.STAGES:
            if stage not in done:
                makers[stage]().write.mode("overwrite").parquet(self._at(f"{run}/{stage}"))
            if stage == stop_after:
                return None
        kept = self.table(run, "entities").select("job", "normal", "id", "legal_name", "kind")
        known = self._known()
        more = kept.join(known.select("job", "normal"), ["job", "normal"], "left_anti")
        if not more.isEmpty():
            more.write.mode("append").parquet(self._at("entities"))
        return self.table(run, "counts")

    def _classified(self, documents: DataFrame) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        out = documents.select("job", "pos", "form", "file", "text", classes.debt_document(F.col("file"), text, F.col("form")).alias("class"))
        about = (F.col("class") == "other") & F.substring(text, 1, DEBT_CHARS).rlike(DEBT_WORDS) | (F.col("class") == "periodic_filing") & F.substring(text, 1, PERIODIC_CHARS).rlike(PERIODIC_WORDS)
        return out.withColumn("candidate", F.col("class").isin(*DEBTISH) | about)

    def _entities(self, run: str, registrants: DataFrame) -> DataFrame:
        hints = self.table(run, "hints").select("job", "pos", "n", "legal_name", "normal", "kind", "points")
        name = F.trim(F.regexp_replace(F.lower("company"), "[^a-z0-9]+", " "))
        parents = registrants.select("job", F.lit(-1).cast(hints.schema["pos"].dataType).alias("pos"), F.lit(0).alias("n"), F.col("company").alias("legal_name"), name.alias("normal"), F.lit("public_parent").alias("kind"), F.lit(96).alias("points"))
        return with_ids(parents.unionByName(hints), self._known())

    def _roles(self, run: str) -> DataFrame:
        """Roles in documents that are contracts or prospectuses: job, pos, id, role, points."""
        wanted = self.table(run, "classified").where(F.col("class").isin(*CONTRACTS, "prospectus")).select("job", "pos")
        hints = self.table(run, "hints").join(wanted, ["job", "pos"], "left_semi")
        return hints.join(self.table(run, "entities").select("job", "normal", "id"), ["job", "normal"]).select("job", "pos", "id", "role", "points").distinct()

    def _counts(self, run: str) -> DataFrame:
        docs = self.table(run, "classified").groupBy("job").agg(F.count("*").alias("documents"), F.count_if("candidate").alias("candidates"))
        entities = self.table(run, "entities").groupBy("job").agg(F.count("*").alias("entities"))
        roles = self.table(run, "roles").groupBy("job").agg(F.count("*").alias("roles"))
        out = docs.join(entities, "job", "left").join(roles, "job", "left")
        return out.select("job", "documents", "candidates", F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("roles", F.lit(0)).alias("roles"), F.lit("complete").alias("status"))
