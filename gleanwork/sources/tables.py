"""Tables and exchange formats: TREC runs and judgments, CSV sheets, JSON lines, versioned indexes."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_SCHEMA, TOKENIZER_VERSION = "gleanwork-index-1", "script-1"


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, unit_id, grade of `qid 0 unit grade` lines; other forms and grades are refused."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter("trim(value) <> ''").select(f.alias("f"))
    out = rows.select(F.col("f")[0].alias("qid"), F.col("f")[2].alias("unit_id"), F.try_element_at("f", F.lit(4)).try_cast("int").alias("grade"), F.size("f").alias("n"))
    if not out.filter("n <> 4 or grade is null or grade not between 0 and 2").isEmpty():
        raise ValueError(f"{path}: lines that aren't `qid 0 unit grade` with a grade of 0 to 2")
    return out.drop("n")


def write_qrels(qrels: DataFrame, path: str) -> None:
    qrels.orderBy("qid", "unit_id").select(F.format_string("%s 0 %s %d", "qid", "unit_id", "grade").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_run(run: DataFrame, name: str, path: str, depth: int = 100) -> None:
    """Scores are depth + 1 - rank."""
    line = F.format_string("%s Q0 %s %d %d %s", "qid", "unit_id", "rank", F.lit(depth + 1) - F.col("rank"), F.lit(name))
    run.filter(F.col("rank") <= depth).orderBy("qid", "rank").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter("trim(value) <> ''").select(
        f[0].alias("qid"), f[2].alias("unit_id"), f[3].cast("int").alias("rank"), f[4].cast("double").alias("score"), f[5].alias("run")
    )


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, cells of several lines, and perhaps a byte order mark."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def write_sheet(df: DataFrame, path: str) -> None:
    first, *rest = df.columns
    df.toDF("﻿" + first, *rest).coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
            return None
        raise


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class IndexStore:
    """Versioned folders of Parquet tables and a table of pointers. A version appears when its pointer does: readers see
    the old one or the new one, and a job that dies in between leaves the old one in place."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self) -> DataFrame | None:
        return read_or_none(self.spark, f"{self.root}/pointers")

    def write(self, case: str, tables: dict[str, DataFrame], embed_model: str = "", embed_dim: int = 0) -> str:
        version = f"{time.time_ns():020d}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{case}/{version}/{name}")
        row = [(case, version, INDEX_SCHEMA, TOKENIZER_VERSION, embed_model, embed_dim, sorted(tables))]
        kind = "case string, version string, schema string, tokenizer string, embed_model string, embed_dim int, tables array<string>"
        self.spark.createDataFrame(row, kind).write.mode("append").parquet(f"{self.root}/pointers")
        return version

    def latest(self, case: str):
        found = self._pointers()
        rows = [] if found is None else found.filter(F.col("case") == case).orderBy(F.desc("version")).limit(1).collect()
        return rows[0] if rows else None

    def load(self, case: str, embed_model: str | None = None) -> dict[str, DataFrame]:
        """An index of another schema, tokenizer or embedding model is an error."""
        at = self.latest(case)
        if at is None or not at["tables"]:
            raise LookupError(f"no index for {case}")
        if (at["schema"], at["tokenizer"]) != (INDEX_SCHEMA, TOKENIZER_VERSION):
            raise ValueError(f"index of {at['schema']}/{at['tokenizer']}; this is {INDEX_SCHEMA}/{TOKENIZER_VERSION}")
        if embed_model is not None and at["embed_model"] != embed_model:
            raise ValueError(f"index embedded by {at['embed_model']}, not {embed_model}")
        return {t: self.spark.read.parquet(f"{self.root}/{case}/{at['version']}/{t}") for t in at["tables"]}

    def delete(self, case: str) -> None:
        """A version without tables."""
        self.write(case, {})

    def clean(self, case: str, keep: int = 2) -> None:
        """Deletes the tables of all but the newest `keep` versions. Readers of older ones fail: let them end first."""
        found = self._pointers()
        old = [] if found is None else found.filter(F.col("case") == case).orderBy(F.desc("version")).select("version").collect()[keep:]
        for r in old:  # one for each time that a case was indexed
            remove(self.spark, f"{self.root}/{case}/{r['version']}")

    # Profiles: vectors of other embeddings, in folders of a version. The newest of a name counts.
    def _profile_table(self) -> DataFrame | None:
        return read_or_none(self.spark, f"{self.root}/profiles")

    def profiles(self, case: str) -> dict[str, str]:
        """Names and folders of the profiles of the case's newest version."""
        at, found = self.latest(case), self._profile_table()
        if at is None or found is None:
            return {}
        mine = found.filter((F.col("case") == case) & (F.col("version") == at["version"])).groupBy("name").agg(F.max("path").alias("path"))
        return {r["name"]: r["path"] for r in mine.collect()}

    def write_profile(self, case: str, name: str, vectors: DataFrame) -> None:
        """vectors: part_id, input_hash, vec, for each part of the index; fewer or more are an error."""
        parts = self.load(case)["parts"]
        if vectors.count() != parts.count():
            raise ValueError(f"profile {name} hasn't one vector for each part")
        version = self.latest(case)["version"]
        path = f"{self.root}/{case}/{version}/profile-{name}-{time.time_ns():020d}"
        vectors.write.parquet(path)
        self.spark.createDataFrame([(case, version, name, path)], "case string, version string, name string, path string").write.mode("append").parquet(f"{self.root}/profiles")

    def load_profile(self, case: str, name: str) -> DataFrame:
        found = self.profiles(case)
        if name not in found:
            raise LookupError(f"{case} has no profile {name}")
        return self.spark.read.parquet(found[name])


def need_reindex(store: IndexStore, cases: DataFrame, model: str, dim: int | None = None) -> list[str]:
    """Cases, ready or archived, whose index is missing, of another schema, or embedded by another model or dimension."""
    out = []
    for r in cases.filter("status in ('ready', 'archived')").select("case_id").orderBy("case_id").collect():
        at = store.latest(r["case_id"])
        same = at is not None and at["tables"] and (at["schema"], at["tokenizer"], at["embed_model"]) == (INDEX_SCHEMA, TOKENIZER_VERSION, model)
        if not same or (dim is not None and at["embed_dim"] != dim):
            out.append(r["case_id"])
    return out


# ---- cases ----
STATES = {"created": ["indexing", "archived"], "indexing": ["ready", "error"], "ready": ["indexing", "archived"], "error": ["indexing", "archived"], "archived": []}
CASES = "case_id string, name string, status string, sources array<string>, error string, updated timestamp, seq bigint"


def create_case(cases: DataFrame, case_id: str, name: str, paths: list[str]) -> DataFrame:
    """The catalog with one more case; an id that it has is an error."""
    if not cases.filter(F.col("case_id") == case_id).isEmpty():
        raise ValueError(f"{case_id} is there already")
    spark = cases.sparkSession
    seq = (cases.agg(F.max("seq")).first()[0] or 0) + 1
    new = spark.createDataFrame([(case_id, name, "created", paths, None, None, seq)], CASES).withColumn("updated", F.current_timestamp())
    return cases.unionByName(new)


def rename_case(cases: DataFrame, case_id: str, name: str) -> DataFrame:
    return cases.withColumn("name", F.when(F.col("case_id") == case_id, name).otherwise(F.col("name")))


def drop_case(cases: DataFrame, store: IndexStore, case_id: str) -> DataFrame:
    """The catalog without a case, whose index is gone, too."""
    store.delete(case_id)
    return cases.filter(F.col("case_id") != case_id)


def list_cases(cases: DataFrame, status: str | None = None) -> DataFrame:
    """The newest first; of one status, if given."""
    return (cases if status is None else cases.filter(F.col("status") == status)).orderBy(F.desc("seq"))


def progress(done: Column, total: Column, seconds: Column, idle: Column, most_idle: float = 120.0) -> Column:
    """percent, eta (seconds; null before anything is done) and whether nothing has been done for `most_idle` seconds."""
    return F.struct(
        F.when(total > 0, F.round(100 * done / total, 1)).otherwise(F.lit(0.0)).alias("percent"),
        F.when(done > 0, F.round(seconds / done * (total - done), 1)).alias("eta"), (idle > most_idle).alias("stalled"),
    )


def change_status(cases: DataFrame, case_id: str, to: str) -> DataFrame:
    """The catalog with one case in another state; a transition that STATES doesn't have is an error."""
    now = cases.filter(F.col("case_id") == case_id).select("status").first()
    if now is None or to not in STATES[now["status"]]:
        raise ValueError(f"{case_id} can't become {to} from {now and now['status']}")
    hit = F.col("case_id") == case_id
    return cases.withColumn("status", F.when(hit, to).otherwise(F.col("status"))).withColumn("updated", F.when(hit, F.current_timestamp()).otherwise(F.col("updated")))


def recover_stuck(cases: DataFrame, minutes: int = 30) -> DataFrame:
    """Cases that have been indexing without a change for so long end in error, whatever STATES says."""
    stuck = (F.col("status") == "indexing") & (F.col("updated") <= F.current_timestamp() - F.expr(f"interval {int(minutes)} minutes"))
    return cases.withColumn("error", F.when(stuck, "stuck").otherwise(F.col("error"))).withColumn("status", F.when(stuck, "error").otherwise(F.col("status")))


def add_sources(cases: DataFrame, case_id: str, paths: list[str]) -> DataFrame:
    more = F.array_distinct(F.concat(F.coalesce("sources", F.array().cast("array<string>")), F.array(*[F.lit(p) for p in paths])))
    return cases.withColumn("sources", F.when(F.col("case_id") == case_id, more).otherwise(F.col("sources")))


def check_failure_rate(done: int, failed: int, most: float = 0.1) -> None:
    if done + failed and failed / (done + failed) > most:
        raise RuntimeError(f"{failed} of {done + failed} embedding batches failed")
