"""An inverted index of text columns: postings, terms and lengths as Parquet tables, and search and BM25 from them.

Postings are ranged and sorted by field and term, so that a term's or a prefix's rows are found by the statistics of files
and row groups without reading the others. Wildcards and fuzzy terms are expanded over the table of terms, never over
texts. Boolean groups are set operations on ids; texts are not read again, and other columns only for leaves on them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.search import B, K1
from orrery.plans.ast import Fields, Group, Leaf, compile_leaf, fuzzy, phrase_words, within_slop
from orrery.plans.ast import wild as wild_pattern
from orrery.session import checkpoint_dir, sort_join


def _less(k: int) -> Callable[[Column], Column]:
    return lambda p: p - k


class TextIndex:
    """The index under a folder. Rows are known by ``id``, a column of unique values of the table that was indexed."""

    def __init__(self, spark: SparkSession, path: str, source: DataFrame | None = None, id_col: str = "doc_id"):
        self.spark, self.path, self.source, self.id_col = spark, path, source, id_col
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        self.postings, self.terms, self.lengths = read("postings"), read("terms"), read("lengths")
        stats = read("stats").collect()  # a row for each field
        self.fields = {r["field"]: (r["mean"] or 1.0) for r in stats}
        self.total = stats[0]["total"] if stats else 0

    @classmethod
    def build(cls, df: DataFrame, id_col: str, text_cols: list[str], path: str | None = None) -> TextIndex:
        """Writes the index of the text columns (texts or arrays of them). Null texts have no postings and length 0."""
        spark = df.sparkSession
        path = path or f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
        fields = Fields.of(df, dict.fromkeys(text_cols, "text"))
        each = reduce(DataFrame.unionByName, [df.select(F.lit(c).alias("field"), F.col(id_col).alias("id"), fields.terms(c).alias("words")) for c in text_cols])
        posted = each.select("field", "id", F.posexplode("words").alias("pos", "term")).groupBy("field", "term", "id").agg(F.sort_array(F.collect_list("pos")).alias("places"))
        posted.repartitionByRange("field", "term").sortWithinPartitions("field", "term", "id").write.parquet(f"{path}/postings")
        spark.read.parquet(f"{path}/postings").groupBy("field", "term").agg(F.count("*").alias("docs")).repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.parquet(f"{path}/terms")
        each.select("field", "id", F.size("words").alias("length")).write.parquet(f"{path}/lengths")
        spark.read.parquet(f"{path}/lengths").groupBy("field").agg(F.count("*").alias("total"), F.avg(F.when(F.col("length") > 0, F.col("length"))).alias("mean")).write.parquet(f"{path}/stats")
        return cls(spark, path, df, id_col)

    def _all(self) -> DataFrame:
        return self.lengths.where(F.col("field") == next(iter(self.fields), "")).select("id")

    def _expanded(self, leaf: Leaf) -> Column | None:
        """The test of a leaf on the table of terms; None where the term is known and needn't be looked for."""
        t = F.col("term")
        return {
            "wildcard": lambda: t.rlike(f"(?s)^{wild_pattern(leaf.value, '.')}$"),
            "regex": lambda: t.rlike(f"^(?:{leaf.value})$"),
            "fuzzy": lambda: fuzzy(t, leaf.value, leaf.edits, leaf.prefix),
        }.get(leaf.kind, lambda: None)()

    def posted(self, leaf: Leaf) -> DataFrame:
        """(id, places) of the postings of a leaf on one term, or on all that it stands for."""
        own = self.postings.where(F.col("field") == leaf.field)
        if leaf.kind == "term":
            return own.where(F.col("term") == leaf.value).select("id", "places")
        if leaf.kind == "prefix":
            return own.where(F.col("term").startswith(leaf.value)).select("id", "places")
        start = leaf.value[: leaf.prefix] if leaf.kind == "fuzzy" else leaf.value.split("*")[0].split("?")[0] if leaf.kind == "wildcard" and "\\" not in leaf.value else ""
        near = lambda df: df.where(F.col("term").startswith(start)) if start else df
        found = near(self.terms.where(F.col("field") == leaf.field)).where(self._expanded(leaf)).select("term")
        return near(own).join(found, "term", "left_semi").select("id", "places")

    def _phrase(self, leaf: Leaf) -> DataFrame:
        words = phrase_words(leaf)
        own = self.postings.where((F.col("field") == leaf.field) & F.col("term").isin(list(dict.fromkeys(words))))
        at = [F.first(F.when(F.col("term") == w, F.col("places")), ignorenulls=True).alias(f"w{k}") for k, w in enumerate(words)]
        rows = own.groupBy("id").agg(*at).where(reduce(lambda a, b: a & b, [F.col(f"w{k}").isNotNull() for k in range(len(words))]))
        # The place of each word less its own in the phrase.
        shifted = [F.transform(f"w{k}", _less(k)) for k in range(len(words))]
        ok = F.size(reduce(F.array_intersect, shifted)) > 0 if leaf.slop == 0 else within_slop(F.array(*shifted), len(words), leaf.slop)
        return rows.where(ok).select("id")

    def ids(self, node: Leaf | Group) -> DataFrame:
        """The distinct ids that match."""
        if isinstance(node, Leaf):
            if node.kind == "all":
                return self._all()
            if node.field in self.fields and node.kind in ("term", "prefix", "wildcard", "regex", "fuzzy"):
                return self.posted(node).select("id").distinct()
            if node.field in self.fields and node.kind == "phrase":
                return self._phrase(node)
            if self.source is None:
                raise ValueError(f"{node.field} isn't indexed, and the table isn't at hand")
            return self.source.where(compile_leaf(node, Fields.of(self.source))).select(F.col(self.id_col).alias("id"))
        got = None
        if node.must:
            got = reduce(lambda a, b: sort_join(a, b, "id", "left_semi"), [self.ids(x) for x in node.must])
        elif node.should:
            got = reduce(DataFrame.unionByName, [self.ids(x) for x in node.should]).distinct()
        for x in node.must_not:
            got = sort_join(self._all() if got is None else got, self.ids(x), "id", "left_anti")
        return self._all().where(F.lit(False)) if got is None else got

    def search(self, df: DataFrame, node: Leaf | Group | None) -> DataFrame:
        """The rows of df whose id matches."""
        if node is None:
            return df.where(F.lit(False))
        return df.join(self.ids(node).select(F.col("id").alias(self.id_col)), self.id_col, "left_semi")

    def bm25(self, node: Leaf | Group) -> DataFrame:
        """(id, score) of what matches: BM25 of terms over exact lengths, 1 for other leaves that hold."""
        leaves = node.leaves() if isinstance(node, Group) else [node]
        parts = []
        for x in leaves:
            if x.kind in ("term", "fuzzy") and x.field in self.fields:
                hits = self.posted(x).groupBy("id").agg(F.sum(F.size("places")).cast("double").alias("tf"))
                docs = hits.agg(F.count("*").cast("double").alias("docs"))
                own = sort_join(hits, self.lengths.where(F.col("field") == x.field).select("id", "length"), "id").join(F.broadcast(docs), F.lit(True))
                idf = F.log1p((self.total - F.col("docs") + 0.5) / (F.col("docs") + 0.5))
                parts.append(own.select("id", (x.boost * idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(self.fields[x.field]))))).alias("score")))
            else:
                parts.append(self.ids(x).select("id", F.lit(float(x.boost)).alias("score")))
        matched = self.ids(node).withColumn("score", F.lit(0.0))
        summed = reduce(DataFrame.unionByName, parts, matched.select("id", "score")).groupBy("id").agg(F.sum("score").alias("score"))
        # What matches by leaves that only forbid or demand has a score of them; what doesn't match at all has none.
        return sort_join(summed, matched.select("id"), "id", "left_semi")


_built: dict[tuple[str, str, tuple[str, ...]], TextIndex] = {}


def index_of(df: DataFrame, name: str, id_col: str, text_cols: list[str]) -> TextIndex:
    """The index of a table known by name, built once in a session."""
    key = (df.sparkSession.sparkContext.applicationId, name, tuple(text_cols))
    if key not in _built:
        _built[key] = TextIndex.build(df, id_col, text_cols)
    return _built[key]
