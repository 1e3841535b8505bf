"""Problem 2: records that differ only in formatting, folded into one each by an incremental ledger."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_dir, written

#: Parts into which the members of each key are dealt where they are joined with it; groups of copies may be of any size.
SALTS = 16
#: Keys of a bucket on average beyond which the ledger is dealt into more buckets.
BUCKET_ROWS = 2_000_000

_FIELD_NAME = r"[^\W\d](?:[\w.\-]*\w)?(?:[ \t][\w.\-]*\w){0,2}"
_SEGMENT = re.compile(rf"^[\s\-*•>#\"'(\[{{]*(?P<k>{_FIELD_NAME})[\"']?\s*[:=]+\s*(?P<v>.*)$", re.S)
_KEY_AT = re.compile(r"(?:^|(?<=[\s;|,{(\[\"'“”«*•>\-]))(?P<k>[^\W\d]\w*)[\"']?\s*[:=]+(?=\s|[\"'\[{(\d\w¿«“]|$)")
_LINE_MARK = re.compile(r"(?m)^[\s>+=~^<$|*•\-–—#]*[>+=~^<|](?=\s|$)|^[>+=~^|\s]+$")
_BETWEEN_DIGITS = re.compile(r"(?<=\d)[^\w]+(?=\d)")
_THOUSANDS = re.compile(r"(?<![\d.,])\d{1,3}(?:,\d{3})+(?![\d,])")


def visible(s: str) -> str:
    """NFKC, case folded, without format characters, marks of direction, variation selectors and controls."""
    s = unicodedata.normalize("NFKC", s).casefold()
    s = unicodedata.normalize("NFKC", s)
    return "".join(c for c in s if c in "\n\t\r" or not (unicodedata.category(c) in ("Cf", "Cc") or "\ufe00" <= c <= "\ufe0f"))


def content(s: str) -> str:
    """What is left of visible text without white space, punctuation and quoting.

    Kept besides letters, marks and digits: symbols, as in C++, x < y and $5, but for those that only quote or list (at the
    start of a line, or alone on it); a sign between two digits (1.5, 3/4, 10:30), a minus before a number that starts a
    word, and % after a digit. A comma that groups thousands is dropped.
    """
    s = _LINE_MARK.sub("", s)
    s = _THOUSANDS.sub(lambda m: m.group().replace(",", ""), s)
    out = []
    for i, c in enumerate(s):
        kind = unicodedata.category(c)[0]
        if kind in "LN" or (kind == "M" and out) or kind == "S" and c not in "`¨´¯¸|":
            out.append(c)
            continue
        before, after = (out[-1] if out else ""), s[i + 1 : i + 2]
        if before.isdigit() and c == "%":
            out.append("%")
        elif c in "-−" and after.isdigit() and (i == 0 or s[i - 1].isspace() or s[i - 1] in "([=:"):
            out.append("-")
        elif i and s[i - 1].isdigit():
            gap = _BETWEEN_DIGITS.match(s, i)
            if gap:
                sign = gap.group().strip()
                out.append(sign[:1] or " ")
    return "".join(out)


def _scalar(v: object) -> str:
    if isinstance(v, dict):
        return "{" + ";".join(sorted(f"{content(visible(str(k)))}={_scalar(x)}" for k, x in v.items())) + "}"
    if isinstance(v, list):
        return "[" + ",".join(_scalar(x) for x in v) + "]"
    if v is True or v is False or v is None:
        return {True: "true", False: "false", None: "null"}[v]
    return content(str(v))


def fields(s: str) -> list[tuple[str, str]] | None:
    """Name and value of each field if the whole (visible) text is a list of at least two named fields, else None."""
    t = s.strip()
    a, b = t.find("{"), t.rfind("}")
    if a >= 0 and b > a and not content(t[:a]) and not content(t[b + 1 :]):
        try:
            obj = json.loads(t[a : b + 1], strict=False)
            if isinstance(obj, dict) and len(obj) > 1:
                return [(content(str(k)), _scalar(v)) for k, v in obj.items()]
        except (ValueError, RecursionError):
            pass
        t = t[a + 1 : b]
    for cut in (r"[\r\n]+", r"\s*[;|]\s*", r"\s*[;|\r\n]+\s*"):
        parts = [p for p in re.split(cut, t) if content(p)]
        if len(parts) > 1:
            found = [_SEGMENT.match(p.strip().strip(",")) for p in parts]
            if all(found) and not any(_KEY_AT.search(m["v"]) for m in found):
                return [(content(m["k"]), content(m["v"])) for m in found]
    at = list(_KEY_AT.finditer(t))
    if len(at) > 1 and not content(t[: at[0].start()]):
        ends = [m.start() for m in at[1:]] + [len(t)]
        return [(content(m["k"]), content(t[m.end() : e])) for m, e in zip(at, ends)]
    return None


def canonical(text: str | None) -> str | None:
    """The canonical form: equal for two texts just if they differ in nothing but formatting. Null stays null."""
    if text is None:
        return None
    s = visible(text)
    listed = fields(s) if (":" in s or "=" in s) else None
    if listed is None:
        return content(s)
    return "\x1e".join(sorted(f"{k}\x1f{v}" for k, v in listed))


def canonical_key(text: Column) -> Column:
    """128-bit key of the canonical form, as hex; null for null. The whole text counts."""

    @F.pandas_udf("string")
    def key(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hashlib.blake2b(canonical(x).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())

    return key(text)


class Ledger:
    """Counts of distinct records by canonical key, grown batch by batch; it can be opened again at its path.

    State in the shared folder, in folders of buckets. ``counts`` has one row per key, in the bucket of the key: copies and
    the earliest representative. ``members`` has one row per record, in the bucket of its id, so that a hot key spreads.
    A batch is aggregated by key first, so that a hot key arrives as one row; it is then full-outer-joined with the counts
    of the buckets that it touches, counts are added and the earlier representative stays. Only those buckets are written
    anew. Records of earlier batches are recognised by id in one join with the members of the buckets touched, however many
    batches there were. Each update ends by adding a line to the manifest (which folder holds each bucket); what an update
    that failed has left is never read. Where buckets hold more than BUCKET_ROWS keys on average, the next update deals
    all into four times as many.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 32):
        self.spark, self.path = spark, (path or shared_dir(spark)).rstrip("/")
        self.state = {"version": 0, "buckets": buckets, "counts": {}, "members": []}
        try:
            lines = spark.read.text(f"{self.path}/manifest")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            state = F.get_json_object("value", "$.version").cast("int")
            self.state = json.loads(lines.orderBy(state.desc()).first()["value"])

    @property
    def version(self) -> int:
        return self.state["version"]

    def _bucket(self, by: str) -> Column:
        return F.pmod(F.xxhash64(by), F.lit(self.state["buckets"])).cast("int")

    def _read(self, what: str, schema: str, only: list[int] | None = None) -> DataFrame:
        """The rows of ``what``, or of its buckets ``only``."""
        if what == "counts":
            paths = [f"{v}/bucket={b}" for b, (v, _) in self.state["counts"].items() if only is None or int(b) in only]
            return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        if not self.state["members"]:
            return self.spark.createDataFrame([], schema)
        out = self.spark.read.option("basePath", f"{self.path}/members").schema(f"{schema}, batch string, bucket int").parquet(*self.state["members"])
        return (out if only is None else out.filter(F.col("bucket").isin(only))).drop("batch", "bucket")

    def _write(self, df: DataFrame, what: str, by: str, tag: str = "new") -> str:
        path = f"{self.path}/{what}/batch={self.version + 1}-{tag}"
        df.withColumn("bucket", self._bucket(by)).repartition(self.state["buckets"], "bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)
        return path

    def update(self, batch: DataFrame, id_col: str, text_col: str, order_col: str | None = None) -> "Ledger":
        """Add the records of ``batch``. Earliest is the smallest ``order_col`` (nulls last), ties by id; by default the smallest id.

        Records with a null id or null text belong to no group and are left out; empty texts are one group. An id counts
        once, with the text in which it comes first (in one batch: of the smallest order, then key). An empty batch
        changes nothing but the version. Further columns are ignored.
        """
        order = F.col(order_col) if order_col else F.col(id_col)
        rec = batch.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), order.alias("ord")).filter(F.col("id").isNotNull() & F.col("_text").isNotNull())
        rec = rec.select("id", "ord", canonical_key(F.col("_text")).alias("key"))
        new = rec.groupBy("id").agg(F.min(F.struct(F.col("ord").isNull().alias("late"), "ord", "key")).alias("x")).select("id", "x.key", "x.ord")
        kind = {f.name: f.dataType.simpleString() for f in new.schema}
        self.state.setdefault("kind", kind)
        members, counts = self._schemas()
        grow = sum(n for _, n in self.state["counts"].values()) > BUCKET_ROWS * self.state["buckets"]
        if grow:
            old, every = written(self._read("counts", counts), "counts"), written(self._read("members", members), "members")
            self.state |= {"buckets": 4 * self.state["buckets"], "counts": {}, "members": []}
            self.state["members"] = [self._write(every, "members", "id", "dealt")]
        new = written(new, "batch")
        if self.state["members"]:
            touched = [r[0] for r in new.select(self._bucket("id")).distinct().collect()]  # one row a bucket
            new = written(new.join(self._read("members", members, touched).select("id"), "id", "left_anti"), "fresh")
        added = self._write(new, "members", "id")
        first = F.min(F.struct(F.col("ord").isNull().alias("late"), "ord", "id")).alias("first")
        fresh = new.groupBy("key").agg(F.count("*").alias("copies"), first)
        if not grow:
            touched = [r[0] for r in new.select(self._bucket("key")).distinct().collect()] if self.state["counts"] else []  # one row a bucket
            old = self._read("counts", counts, touched)
        both = old.alias("o").join(fresh.alias("n"), "key", "full_outer").select(
            "key", (F.coalesce("o.copies", F.lit(0)) + F.coalesce("n.copies", F.lit(0))).alias("copies"), F.least("o.first", "n.first").alias("first"),
        )
        at = self._write(both, "counts", "key")
        per = self.spark.read.schema("key string, bucket int").parquet(at).groupBy("bucket").agg(F.count("*").alias("n")).collect()  # one row a bucket
        self.state |= {"version": self.version + 1, "counts": self.state["counts"] | {str(r["bucket"]): [at, r["n"]] for r in per}, "members": [*self.state["members"], added] if per and (not grow or new.limit(1).count()) else self.state["members"]}
        self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/manifest")
        return self

    def _schemas(self) -> tuple[str, str]:
        kind = self.state.get("kind", {"id": "string", "ord": "string"})
        return f"id {kind['id']}, key string, ord {kind['ord']}", f"key string, copies bigint, first struct<late:boolean,ord:{kind['ord']},id:{kind['id']}>"

    def members(self) -> DataFrame:
        """id, key, ord of every record counted."""
        return self._read("members", self._schemas()[0])

    def groups(self) -> DataFrame:
        """kept_id, copies: one row per canonical key."""
        return self._read("counts", self._schemas()[1]).select("key", F.col("first.id").alias("kept_id"), "copies")

    def duplicates(self) -> DataFrame:
        """kept_id and id of each record that is not its group's representative."""
        many = self.groups().filter(F.col("copies") > 1).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        spread_out = self.members().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        return spread_out.join(many, ["key", "salt"]).filter(F.col("id") != F.col("kept_id")).select("kept_id", "id")
