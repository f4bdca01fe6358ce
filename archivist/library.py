"""The library in one object: imports, browsing, facets, statistics and schemas over stored tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivist.functions.embed import embed
from archivist.functions.identity import SITE
from archivist.operators import catalog as c
from archivist.operators import import_log
from archivist.operators import merge as m
from archivist.operators.hybrid import Found, hybrid_search
from archivist.operators.keyword_index import KeywordIndex, search_fields
from archivist.operators.vector_index import LOCAL, VectorIndex, media_text
from archivist.sources import archive, exports, schema_infer
from archivist.sources.settings import Settings
from archivist.sources.store import Store, delete, scratch

TIMES = {"saves": "saved_at", "likes": "liked_at"}


class Busy(Exception):
    """Something that has to end first is still running."""


@dataclass
class Page:
    """A page of items, and how it came about: mode is that of the search, like, or none without one; capped: more may match than were ranked."""

    items: DataFrame
    total: int
    total_pages: int
    mode: str = "none"
    provider: str | None = None
    fallback: bool = False
    reason: str | None = None
    capped: bool = False


class Library:
    """Each library (saves, likes) is one table of items with first and last import; imports and schemas have their own.

    site: the pattern of the hosts whose addresses are items, any by default. providers: embedders of texts besides the offline one, for
    searches, by name."""

    def __init__(self, spark: SparkSession, folder: str, site: str = SITE, providers: dict[str, Callable[[str], list[float]]] | None = None):
        self.spark, self.folder, self.store, self.site = spark, folder.rstrip("/"), Store(spark, folder), site
        self.embedders = {"local": lambda q: embed(q).tolist()} | (providers or {})
        self.settings = Settings(self.store)

    def ingest(self, path: str) -> int:
        """Read archives and files under the path, merge them into the library; returns the import's id."""
        work = scratch(self.spark)
        archive.with_hash(archive.scan(self.spark, path)).write.parquet(f"{work}/files")  # archives are opened once
        files = self.spark.read.parquet(f"{work}/files")
        import_id = 1 + (self.store.read("imports").agg(F.max("id")).first()[0] if self.store.version("imports") else 0)
        hashes = F.sha2(F.concat_ws("", F.array_sort(F.collect_list("content_hash"))), 256)
        content_hash = files.agg(hashes).first()[0]
        before = self.store.read("imports") if self.store.version("imports") else None
        repeated = before is not None and bool(before.filter((F.col("content_hash") == content_hash) & (F.col("status") == "completed")).head(1))
        counts = {"added": 0, "updated": 0, "skipped": 0, "found": 0}
        parsed, warnings = {}, []
        for library, at in TIMES.items():
            source = archive.liked_source(F.col("name"))
            mine = files.withColumn("source", source).filter(F.col("source").isNotNull() if library == "likes" else archive.saved_file(F.col("name")) & F.col("source").isNull())
            exports.raw_items(mine, library).write.parquet(f"{work}/raw_{library}")
            raw = self.spark.read.parquet(f"{work}/raw_{library}")
            exports.parsed(raw, library, self.site).drop("_ord").write.parquet(f"{work}/{library}")
            new = parsed[library] = self.spark.read.parquet(f"{work}/{library}")
            warnings.append(raw.filter("warning is not null").select("warning"))
            lists = library == "saves"
            old = self.items(library) if self.store.version(library) else new.limit(0).withColumns({"first_seen_import_id": F.lit(0).cast("long"), "last_seen_import_id": F.lit(0).cast("long")})
            merged = m.merge_state(old, new, import_id, at, lists, () if lists else ("source",))
            self.store.write(f"{library}_merge", merged)
            merged = self.store.read(f"{library}_merge")
            self.store.write(library, merged.drop("outcome"))
            for r in merged.groupBy("outcome").count().collect():  # four outcomes
                if r["outcome"] != "kept":
                    counts[r["outcome"]] += r["count"]
                    counts["found"] += r["count"]
        found = schema_infer.schemas(files.withColumn("import_id", F.lit(import_id).cast("long")))
        self.store.write("schemas", schema_infer.replace_schemas(self.store.read("schemas"), found, import_id) if self.store.version("schemas") else found)
        status = "failed" if not counts["found"] else "duplicate" if repeated else "completed"
        this = F.lit(import_id).cast("long").alias("import_id")
        kind = F.when(archive.liked_source(F.col("name")).isNotNull(), "likes").when(archive.saved_file(F.col("name")), "saves")
        log = import_log.logs(files.select(this, "name", kind.alias("library")), parsed["saves"].select("*", this), parsed["likes"].select("*", this), warnings[0].unionByName(warnings[1]).select(this, "warning"))
        row = self.spark.range(1).join(log, F.lit(True), "left").select(F.lit(import_id).cast("long").alias("id"), F.lit(path).alias("filename"), F.lit(content_hash).alias("content_hash"), F.current_timestamp().alias("imported_at"), *[F.lit(counts[k]).cast("long").alias(f"items_{k}") for k in ("found", "added", "updated", "skipped")], F.lit(status).alias("status"), "notes")
        self.store.write("imports", before.unionByName(row) if before is not None else row)
        delete(self.spark, work)
        return import_id

    def items(self, library: str) -> DataFrame:
        return self.store.read(library)

    def stats(self) -> dict[str, DataFrame]:
        types = {f"{t}s": t for t in ("post", "reel", "igtv", "story")}
        return {k: c.stats(self.items(k), types).withColumn("comments", F.lit(0).cast("long")) for k in TIMES}  # comments are never stored

    def keyword_index(self, library: str) -> KeywordIndex:
        return KeywordIndex(self.spark, f"{self.folder}/_search/keyword/{library}")

    def vector_index(self, library: str, provider: str = "local", **more) -> VectorIndex:
        return VectorIndex(self.spark, f"{self.folder}/_search/vectors", library, provider, **more)

    def sync_keywords(self, library: str) -> dict[str, int]:
        return self.keyword_index(library).sync(search_fields(self.items(library), library, id_col="media_key"))

    def sync_search(self, library: str) -> dict[str, dict[str, int]]:
        """Bring the keyword index and the offline vector index up to the items: only what is new, changed or gone is worked on."""
        items = self.items(library).withColumn("id", F.col("media_key"))
        words = self.sync_keywords(library)
        texts = items.select("id", media_text(*[F.col(n) for n in ("author_username", "shortcode", "media_key", "media_type")]).alias("text"))
        index = self.vector_index(library)
        counts = index.sync(texts, other=self.vector_index("likes" if library == "saves" else "saves"))
        gone = index.vectors().join(texts, "id", "left_anti").select("id")
        counts["removed"] = gone.count()
        if counts["removed"]:
            index.remove(gone)
        return {"keyword": words, "vectors": counts}

    def search(self, library: str, q: str, limit: int = c.RANKED_CAP, provider: str | None = None, preferred: str | None = None) -> Found:
        """Ranked (id, rank, score, source); ids are media keys. Providers that the settings turn off aren't asked."""
        enabled = [name for name in self.embedders if self.settings.enabled(name, library)]
        ask = {name: lambda q, n, name=name: self.vector_index(library, name).search(self.embedders[name](q), n, self._profile(library, name)) for name in enabled}
        return hybrid_search(self.spark, q, limit, self.keyword_index(library).search, ask, provider, preferred or self.settings.preferred())

    def _profile(self, library: str, provider: str) -> dict:
        mine = self.vector_index(library, provider).profile()
        return mine if provider != "local" and mine else LOCAL

    def browse(self, library: str, **params: str) -> DataFrame:
        return self.page(library, **params).items

    def page(self, library: str, **params: str) -> Page:
        """A page of items that meet all conditions. With q they are those that the hybrid search ranks, in its order; if it finds nothing at
        all, those that hold the text somewhere."""
        request = c.browse_request(params, library)
        items = self.items(library)
        if request.collection:
            items = items.filter(F.array_contains("collections", request.collection))
        other = self.items("likes" if library == "saves" else "saves").select(F.col("media_key").alias("media_id"))
        keyed = items.withColumn("id", F.col("media_key"))
        found = self.search(library, request.q, provider=request.provider) if request.q else None
        hits = found.hits.select("id", "rank") if found is not None and found.mode != "none" else None
        rows = c.filtered(keyed, request, others=other, ranked=hits)
        total = rows.count()
        out = Page(c.page(rows, c.browse_order(TIMES[library], hits is not None), request.page, request.page_size), total, -(-total // request.page_size))
        if found is not None:
            out.mode, out.provider, out.fallback, out.reason = "like" if hits is None else found.mode, found.provider, found.fallback, found.reason
            out.capped = found.truncated and hits is not None
        return out

    def facets(self, library: str) -> dict[str, DataFrame]:
        out = {"authors": c.facet(self.items(library), "author_username")}
        if library == "saves":
            out["collections"] = c.facet(self.items(library).select(F.explode("collections").alias("c")), "c")
        return out

    def imports(self) -> DataFrame:
        return self.store.read("imports").orderBy(F.desc("id"))

    def import_logs(self) -> DataFrame:
        """(id, log) of the imports; an import without a readable log has none."""
        return self.imports().select("id", import_log.decoded(F.col("notes")).alias("log"))

    def schemas(self, import_id: int | None = None) -> DataFrame:
        return self.schema_catalog(None if import_id is None else str(import_id)).files

    def schema_catalog(self, which: str | None = None) -> schema_infer.Catalog:
        return schema_infer.catalog(self.store.read("imports"), self.store.read("schemas"), which)

    def counted(self, import_id: int) -> dict[str, int]:
        """How many items of each library the import brought in."""
        return {k: self.items(k).filter(F.col("first_seen_import_id") == import_id).count() for k in TIMES}

    def discard(self, import_id: int, jobs: DataFrame | None = None) -> dict[str, int]:
        """Take out what the import brought in; what it only touched stays. Refused while a job of (job_id, import_id, state) for it is open. How many
        rows of each library went, and those of the import before and after."""
        if jobs is not None:
            open_ = jobs.filter((F.col("import_id") == import_id) & F.col("state").isin("pending", "running")).orderBy("job_id").head(1)
            if open_:
                raise Busy(f"job {open_[0]['job_id']} of the import has to end or be cancelled first")
        before = self.counted(import_id)
        for library in TIMES:
            if before[library]:
                self.store.write(library, self.items(library).filter(F.col("first_seen_import_id") != import_id))
        after = self.counted(import_id)
        return {"before": sum(before.values()), "after": sum(after.values())} | {f"{k}_deleted": before[k] - after[k] for k in TIMES}
