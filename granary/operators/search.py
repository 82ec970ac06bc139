"""The search index: tables of a corpus, a handle with a scope, and the lookups on it."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.errors import AmbiguousIdError, OutOfScopeError, SearchIndexError, SearchIndexMissing, StaleSearchIndex
from granary.functions import text as tx
from granary.operators import copies as cp
from granary.operators import filters, ordered
from granary.operators import postings as ps
from granary.session import materialize

#: What a scope filter may name, and its type.
SCOPE_FIELDS = {
    "chunk_id": "string", "doc_id": "string", "doc_chunk_index": "int", "source": "string", "source_file": "string", "chunk_label": "string",
    "task_id": "string", "step_id": "string", "source_scope": "string", "resource_type": "string", "type": "string", "content_module_id": "string",
}
HIT_COLUMNS = ["chunk_id", "doc_id", "doc_chunk_index", "source", "source_file", "task_id", "resource_type", "type", "copy_rep"]
SHOWN_AMBIGUOUS = 5
TABLES = ("chunks", "postings", "sizes", "copy_groups", "overlap_pairs")


def _field(name: str) -> Column:
    """A metadata value as text; an empty one counts as missing, and a nested ``metadata`` object is looked into."""
    value = [F.get_json_object("metadata", f"$.{p}{name}") for p in ("", "metadata.")]
    return F.coalesce(*[F.when(v != "", v) for v in value])


def index_rows(chunks: DataFrame) -> DataFrame:
    """Chunk rows with the fields promoted from their metadata, plain text, headings and the heading carried over.

    A chunk without a position sorts after those with one.
    """
    has_type = "resource_type" in chunks.columns
    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = chunks.where("chunk_id is not null").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("doc_id", F.coalesce(empty("doc_id"), empty("source_file"), F.lit("")))
    kind = _field("resource_type")
    rows = rows.select(
        "chunk_id", "doc_id", F.col("doc_chunk_index").cast("int").alias("doc_chunk_index"),
        F.coalesce(_field("source_document_name"), empty("source_file"), F.col("doc_id")).alias("source"), "source_file",
        _field("chunk_label").alias("chunk_label"), F.coalesce(_field("task_id"), empty("content_module_id")).alias("task_id"), _field("step_id").alias("step_id"),
        _field("source_scope").alias("source_scope"), (F.coalesce(kind, F.col("resource_type")) if has_type else kind).alias("resource_type"), _field("type").alias("type"),
        "content_module_id", "text", tx.plain(F.col("text")).alias("plain"), "metadata",
    )
    rows = rows.withColumn("headings", tx.headings_of("plain"))
    return ordered.carry(rows, F.try_element_at(F.col("headings.title"), F.lit(-1)), "heading_before")


def build(chunks: DataFrame, path: str, core: str = "", width: int = cp.WIDTH, groups: bool = True) -> None:
    """Write the index tables under ``path``; the manifest comes last and makes them valid.

    Without ``groups`` copy groups and overlaps are left out, which cost more than the rest. Postings are range-partitioned by token, so a search reads the files of its tokens only.
    """
    spark = chunks.sparkSession
    near = cp.near_table(chunks)
    rows = index_rows(chunks).join(near.select("chunk_id", "copy_rep").distinct(), "chunk_id", "left").withColumn("copy_rep", F.coalesce("copy_rep", "chunk_id"))
    rows.repartitionByRange("doc_id", "chunk_id").sortWithinPartitions("doc_id", "doc_chunk_index").write.mode("overwrite").parquet(f"{path}/chunks")
    posts = ps.postings(spark.read.parquet(f"{path}/chunks"))
    posts.repartitionByRange("token", "chunk_id").sortWithinPartitions("token", "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
    ps.lengths(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/sizes")
    if groups:
        cp.overlap_pairs(near, width).write.mode("overwrite").parquet(f"{path}/overlap_pairs")
        pairs = spark.read.parquet(f"{path}/overlap_pairs")
        all_ = cp.identical_groups(chunks).unionByName(cp.near_groups(near)).unionByName(cp.overlap_groups(pairs, near))
        all_.write.mode("overwrite").parquet(f"{path}/copy_groups")
    totals = spark.read.parquet(f"{path}/sizes").agg(F.count("*"), F.avg("size")).first()
    manifest = {"format": 1, "core": core, "tables": list(TABLES if groups else TABLES[:3]), "chunks": spark.read.parquet(f"{path}/chunks").count(), "sized": totals[0], "mean_size": totals[1]}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


@dataclass
class SearchResult:
    """``hits`` (ranked), ``total``, ``rows`` (all hits, unranked), and counts of all hits ``by_doc`` and ``by_module``; ``shown`` is how many hits are kept."""

    hits: DataFrame
    rows: DataFrame
    by_doc: DataFrame
    by_module: DataFrame
    query: dict
    limit: int | None = None
    filter: dict = field(default_factory=dict)

    @cached_property
    def total(self) -> int:
        return self.rows.count()

    @property
    def shown(self) -> int:
        return self.total if self.limit is None else min(self.total, self.limit)

    @property
    def truncated(self) -> bool:
        return self.shown < self.total


@dataclass(frozen=True)
class SearchIndex:
    """An immutable handle: tables, and the filter that scopes every lookup but no score."""

    tables: dict[str, DataFrame]
    rows: int
    mean_size: float
    scope: dict = field(default_factory=dict)
    core: str = ""

    @classmethod
    def open(cls, spark: SparkSession, path: str, core: str | None = None, scope: dict | None = None) -> SearchIndex:
        try:
            manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        except Exception as e:
            raise SearchIndexMissing(f"no search index under {path}") from e
        if manifest.get("format") != 1 or (core is not None and manifest["core"] != core):
            raise StaleSearchIndex(f"the index under {path} was built from other data")
        tables = {t: spark.read.parquet(f"{path}/{t}") for t in manifest.get("tables", TABLES)}
        return cls(tables, manifest["chunks"], manifest["mean_size"] or 0.0, filters.validate(scope), manifest["core"])

    @classmethod
    def over(cls, chunks: DataFrame, scope: dict | None = None) -> SearchIndex:
        """An index for this session: rows with their ``copy_rep`` and postings are written to the shared folder once; groups and overlaps are not computed."""
        near = cp.near_table(chunks)
        rows = index_rows(chunks).join(near.select("chunk_id", "copy_rep").distinct(), "chunk_id", "left")
        rows = materialize(rows.withColumn("copy_rep", F.coalesce("copy_rep", "chunk_id")), "index-rows")
        posts = materialize(ps.postings(rows), "index-postings")
        sizes = materialize(ps.lengths(posts), "index-sizes")
        total = sizes.agg(F.count("*"), F.avg("size")).first()
        return cls({"chunks": rows, "postings": posts, "sizes": sizes}, total[0], total[1] or 0.0, filters.validate(scope))

    def where(self, filt: dict | None) -> SearchIndex:
        """A handle on what also matches ``filt``; this one stays as it is."""
        return replace(self, scope=filters.conjunction(self.scope, filt))

    @property
    def chunks(self) -> DataFrame:
        rows = self.tables["chunks"]
        return rows.where(filters.to_column(self.scope, SCOPE_FIELDS)) if self.scope else rows

    def table(self, name: str) -> DataFrame:
        """A table, restricted to the scope. Pairs need both representatives in it."""
        if name not in self.tables:
            raise SearchIndexError(f"the index has no {name}: it was built without groups")
        df = self.tables[name]
        if name == "chunks":
            return self.chunks
        if not self.scope:
            return df
        ids = self.chunks.select("chunk_id")
        if name == "overlap_pairs":
            reps = self.chunks.select("copy_rep").distinct()
            return df.join(reps.withColumnRenamed("copy_rep", "chunk_a"), "chunk_a", "left_semi").join(reps.withColumnRenamed("copy_rep", "chunk_b"), "chunk_b", "left_semi").select(*df.columns)
        return df.join(ids, "chunk_id", "left_semi")

    # Ids -----------------------------------------------------------------------------

    def _resolve(self, column: str, value: str, what: str) -> str:
        """The one id equal to ``value``, else the only one it begins."""
        near = self.chunks.where(F.col(column).startswith(value)).select(column).distinct().orderBy(column).limit(SHOWN_AMBIGUOUS + 1)
        found = [r[0] for r in near.collect()]
        if value in found:
            return value
        if len(found) == 1:
            return found[0]
        if found:
            more = " and more" if len(found) > SHOWN_AMBIGUOUS else ""
            raise AmbiguousIdError(f"{what} {value!r} fits {', '.join(found[:SHOWN_AMBIGUOUS])}{more}")
        if self.scope and not self.tables["chunks"].where(F.col(column).startswith(value)).isEmpty():
            raise OutOfScopeError(f"{what} {value!r} exists, but not in this scope")
        raise SearchIndexError(f"no {what} {value!r}")

    def resolve_chunk(self, value: str) -> str:
        return self._resolve("chunk_id", value, "chunk")

    def resolve_module(self, value: str) -> str:
        return self._resolve("task_id", value, "module")

    def documents(self, value: str) -> DataFrame:
        """``(doc_id)`` of all documents with this title in any case, else of the document with this id or prefix."""
        titled = self.chunks.where(F.lower("source") == value.lower()).select("doc_id").distinct()
        if not titled.isEmpty():
            return titled
        return self.chunks.where(F.col("doc_id") == self._resolve("doc_id", value, "document")).select("doc_id").distinct()

    def resolve_doc(self, value: str) -> list[str]:
        """The ids of :meth:`documents`, in order."""
        return [r[0] for r in self.documents(value).orderBy("doc_id").collect()]

    # Search --------------------------------------------------------------------------

    def search(
        self, all: list[str] = (), any: list[list[str] | str] = (), not_: list[str] = (), phrase: list[str] = (), near: list[tuple] = (), regex: list[str] = (), substring: list[str] = (),
        word: bool = True, modules: list[str] = (), general_only: bool = False, docs: list[str] = (), exclude_docs: list[str] = (), types: list[str] = (), titles: bool = False, limit: int | None = None,
    ) -> SearchResult:
        """Chunks for which every condition holds, best first, or in document order where nothing ranks them.

        ``any``: groups of which one term each must occur (terms given singly are one
        group). ``near``: ``(term, term, ..., distance)``. With ``word=False`` terms are
        substrings, case and punctuation as written but case-insensitive. The scope limits what is
        returned; scores are those of the whole index.
        """
        if limit is not None and limit < 0:
            raise SearchIndexError("a limit is not negative")
        groups = [[t] if isinstance(t, str) else list(t) for t in any]
        if any and isinstance(any[0], str):
            groups = [list(any)]
        conditions = self._conditions(modules, general_only, types)
        expression = ps.Expression()
        text = F.lower("plain")
        needles = [n for n in substring]
        if word:
            expression.all += [ps.Phrase.of(t) for t in all]
            expression.any += [[ps.Phrase.of(t) for t in g] for g in groups]
            expression.not_ += [ps.Phrase.of(t) for t in not_]
        else:
            needles += list(all)
            conditions += [F.array_contains(F.array(*[F.contains(text, F.lit(t.lower())) for t in g]), True) for g in groups]
            conditions += [~F.contains(text, F.lit(t.lower())) for t in not_]
        expression.all += [ps.Phrase.of(p) for p in phrase]
        expression.all += [ps.Near(tuple(ps.Phrase.of(t) for t in n if isinstance(t, str)), next((x for x in n if isinstance(x, int)), 10)) for n in near]
        conditions += [F.contains(text, F.lit(n.lower())) for n in needles]
        conditions += [F.col("plain").rlike(f"(?imU){_java(r)}") for r in regex]
        rows = self.chunks
        for c in conditions:
            rows = rows.where(c)
        for names, how in ((docs, "left_semi"), (exclude_docs, "left_anti")):
            if names:
                rows = rows.join(reduce(DataFrame.union, [self.documents(d) for d in names]), "doc_id", how)
        if expression.scored():
            # Postings are matched once; statistics, hits and totals all come from what is written here.
            counted = materialize(ps.counted(self.tables["postings"], expression, titles), "matches")
            scored = ps.bm25(ps.hits(counted), ps.statistics(counted), self.tables["sizes"], self.rows, self.mean_size)
            rows = rows.join(scored, "chunk_id")
        elif expression.not_:
            every = ps.Expression(any=[expression.not_])
            rows = rows.join(ps.hits(ps.counted(self.tables["postings"], every, titles)), "chunk_id", "left_anti").withColumn("score", F.lit(None).cast("double"))
        elif conditions or docs or exclude_docs:
            rows = rows.withColumn("score", F.lit(None).cast("double"))
        else:
            raise SearchIndexError("no condition given")
        order = [F.col("score").desc_nulls_last(), "source", "doc_id", *ordered.order()]
        counted = rows.groupBy("doc_id", "task_id").count()
        by_doc = counted.groupBy("doc_id").agg(F.sum("count").alias("hits")).orderBy(F.desc("hits"), "doc_id")
        by_module = counted.groupBy("task_id").agg(F.sum("count").alias("hits")).orderBy(F.desc("hits"), "task_id")
        first = self._first(expression, needles, list(regex))
        shown = rows.withColumn("match_at", first).orderBy(*order)
        shown = shown.limit(limit) if limit is not None else shown
        heading = F.coalesce(F.try_element_at(F.transform(F.filter("headings", lambda h: h["offset"] <= F.col("match_at")), lambda h: h["title"]), F.lit(-1)), F.col("heading_before"))
        shown = shown.select(*HIT_COLUMNS, "score", heading.alias("heading"), tx.snippet(F.col("plain"), F.col("match_at")).alias("snippet"))
        query = {k: v for k, v in {"all": list(all), "any": groups, "not": list(not_), "phrase": list(phrase), "near": list(near), "regex": list(regex), "substring": list(substring)}.items() if v}
        return SearchResult(shown, rows, by_doc, by_module, query, limit, self.scope)

    def _conditions(self, modules, general_only, types) -> list[Column]:
        out = []
        if modules or general_only:
            inside = F.col("task_id").isin([self.resolve_module(m) for m in modules]) if modules else F.lit(False)
            out.append(F.coalesce(inside, F.lit(False)) | (F.col("task_id").isNull() if general_only else F.lit(False)))
        if types:
            out.append(F.coalesce(F.col("resource_type").isin(list(types)), F.lit(False)) | F.coalesce(F.col("type").isin(list(types)), F.lit(False)))
        return out

    @staticmethod
    def _first(expression: ps.Expression, needles: list[str], regexes: list[str]) -> Column:
        """Offset of the first match, 0 where none can be placed."""
        places = [F.locate(n.lower(), F.lower("plain")) for n in needles]
        places += [F.regexp_instr("plain", F.lit(f"(?imU){_java(r)}")) for r in regexes]
        for x in expression.scored():
            for p in x.phrases if isinstance(x, ps.Near) else (x,):
                pattern = r"(?iU)(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(map(re.escape, p.tokens)) + ("" if p.prefix else r"(?![\p{L}\p{N}])")
                places.append(F.regexp_instr("plain", F.lit(pattern)))
        if not places:
            return F.lit(0)
        places = [F.when(p > 0, p - 1) for p in places]
        return F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(0))

    # Reading around -------------------------------------------------------------------

    def chunk(self, value: str) -> DataFrame:
        return self.chunks.where(F.col("chunk_id") == self.resolve_chunk(value))

    def neighbors(self, value: str, radius: int = 1) -> DataFrame:
        """The chunk and those up to ``radius`` places from it in its document, with their offset from it."""
        if radius < 0:
            raise SearchIndexError("a radius is not negative")
        target = self.resolve_chunk(value)
        at = self.tables["chunks"].where(F.col("chunk_id") == target).select("doc_id", "doc_chunk_index").first()
        rows = self.chunks.where(F.col("doc_id") == at[0]).select("chunk_id", "doc_id", "doc_chunk_index", "source", "plain")
        far = F.coalesce("doc_chunk_index", F.lit(1 << 40))
        here = at[1] if at[1] is not None else 1 << 40
        later = (far > here) | ((far == here) & (F.col("chunk_id") > target))
        # Two top-k selections: no ordering of the whole document.
        before = rows.where(~later & (F.col("chunk_id") != target)).orderBy(far.desc(), F.desc("chunk_id")).limit(radius)
        after = rows.where(later).orderBy(far, "chunk_id").limit(radius)
        place = Window.orderBy(far, "chunk_id")  # over at most radius rows
        before = before.withColumn("offset", F.row_number().over(Window.orderBy(far.desc(), F.desc("chunk_id"))) * -1)
        after = after.withColumn("offset", F.row_number().over(place))
        own = rows.where(F.col("chunk_id") == target).withColumn("offset", F.lit(0))
        found = before.unionByName(own).unionByName(after)
        return found.select("offset", "chunk_id", "doc_id", "doc_chunk_index", "source", "plain").orderBy("offset")

    def outline(self, value: str) -> DataFrame:
        """The document's chunks in order, with their headings, the one carried over, and their length."""
        rows = self.chunks.join(self.documents(value), "doc_id", "left_semi").orderBy("doc_id", *ordered.order())
        titles = F.col("headings.title")
        return rows.select("doc_id", "chunk_id", "doc_chunk_index", F.get(titles, F.lit(0)).alias("heading"), titles.alias("headings"), "heading_before", F.length("plain").alias("chars"))

    def copies(self, value: str) -> DataFrame:
        """``(kind, chunk_id, doc_id, source, grouped, containment, containment_larger)`` of a chunk's copies."""
        target = self.resolve_chunk(value)
        rows = self.chunks.select("chunk_id", "doc_id", "source", "copy_rep")
        groups = self.table("copy_groups")
        mine = groups.where(F.col("chunk_id") == target).select("group_id")
        members = groups.join(mine, "group_id", "left_semi").where(F.col("chunk_id") != target).select("kind", "chunk_id")
        rep = self.tables["chunks"].where(F.col("chunk_id") == target).select("copy_rep").first()[0]
        pairs = self.tables["overlap_pairs"].where((F.col("chunk_a") == rep) | (F.col("chunk_b") == rep))
        paired = pairs.select(F.when(F.col("chunk_a") == rep, F.col("chunk_b")).otherwise(F.col("chunk_a")).alias("copy_rep"), "containment", "containment_larger")
        same = members.where("kind <> 'overlap'").join(rows, "chunk_id").select("kind", "chunk_id", "doc_id", "source", F.lit(True).alias("grouped"), F.lit(None).cast("double").alias("containment"), F.lit(None).cast("double").alias("containment_larger"))
        grouped = members.where("kind = 'overlap'").select("chunk_id", F.lit(True).alias("grouped"))
        over = rows.where(F.col("chunk_id") != target).join(paired, "copy_rep", "left").join(grouped, "chunk_id", "left").where("grouped or containment is not null")
        own = F.col("copy_rep") == rep
        over = over.select(F.lit("overlap").alias("kind"), "chunk_id", "doc_id", "source", F.coalesce("grouped", F.lit(False)).alias("grouped"), F.when(own, 1.0).otherwise(F.col("containment")).alias("containment"), F.when(own, 1.0).otherwise(F.col("containment_larger")).alias("containment_larger"))
        return same.unionByName(over).orderBy("kind", "source", "chunk_id")

    def badges(self, hits: DataFrame) -> DataFrame:
        """``hits`` with ``copies``: kind, group and in-scope size of each group with more than one member in scope."""
        groups = self.table("copy_groups")
        sizes = groups.groupBy("group_id", "kind").agg(F.count_distinct("chunk_id").alias("size")).where("size > 1")
        own = groups.join(sizes, ["group_id", "kind"]).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("kind", "group_id", "size"))).alias("copies"))
        return hits.join(own, "chunk_id", "left")

    def modules(self) -> DataFrame:
        """``(task_id, chunks, docs)`` in order of module, general chunks left out."""
        rows = self.chunks.where("task_id is not null").groupBy("task_id")
        return rows.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("docs")).orderBy("task_id")

    def scope_summary(self) -> DataFrame:
        return self.chunks.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("docs"), F.count_distinct("task_id").alias("modules"), F.count_if(F.col("task_id").isNull()).alias("general"))


def _java(pattern: str) -> str:
    """A Python pattern for the JVM's engine; only the spelling of named groups differs."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise SearchIndexError(f"bad regular expression {pattern!r}: {e}") from e
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<")).replace(r"\Z", r"\z")
