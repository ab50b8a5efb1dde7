"""Object index and content-addressed chunks: listings, range reads, deltas, write merging.

index: bucket, key, path, size, hash, content (binary). chunks: path, offset, size, hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered

CHUNK = 4 << 20


def buckets(index: DataFrame) -> DataFrame:
    return index.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"))


def common_prefix(key: Column, prefix: str, delimiter: str) -> Column:
    """The group of a key below `prefix`; null where no delimiter follows."""
    rest = F.substring(key, len(prefix) + 1, 1 << 30)
    at = F.instr(rest, delimiter)
    return F.when(at > 0, F.concat(F.lit(prefix), F.left(rest, at - 1 + F.lit(len(delimiter)))))


def listing(index: DataFrame, bucket: str, prefix: str = "", delimiter: str = "/") -> DataFrame:
    """(prefix, key): one row for each common prefix, and the objects without one."""
    k = index.where((F.col("bucket") == bucket) & F.col("key").startswith(prefix)).select(common_prefix(F.col("key"), prefix, delimiter).alias("prefix"), "key")
    groups = k.where("prefix IS NOT NULL").select("prefix", F.lit(None).cast("string").alias("key")).distinct()
    return groups.unionByName(k.where("prefix IS NULL"))


def page(index: DataFrame, bucket: str, after: str, most: int) -> DataFrame:
    """Objects after a key, in byte order, with whether more follow and the key to go on from."""
    rows = index.where((F.col("bucket") == bucket) & (F.col("key") > after)).orderBy("key").limit(most + 1).select("key", "size", "hash")
    facts = rows.agg(F.sort_array(F.collect_list("key")).alias("k"))
    more = F.size("k") > most
    return rows.join(F.broadcast(facts)).where(F.col("key") <= F.element_at("k", F.least(F.size("k"), F.lit(most)))).select("key", "size", "hash", more.alias("truncated"), F.when(more, F.element_at("k", most)).alias("next_key"))


def chunked(index: DataFrame, size: int = CHUNK) -> DataFrame:
    """(path, offset, size, hash, data) of each chunk; an empty object has none."""
    starts = F.when(F.octet_length("content") > 0, F.sequence(F.lit(0), F.octet_length("content") - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    c = index.select("path", "content", F.explode(starts).alias("offset"))
    data = F.substring("content", F.col("offset") + 1, F.lit(size))
    return c.select("path", F.col("offset").cast("long").alias("offset"), F.octet_length(data).cast("long").alias("size"), F.sha2(data, 256).alias("hash"), data.alias("data"))


def store(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks to write: each content once, and only what the store lacks. Contents are picked after the hashes have met."""
    first = chunks.groupBy("hash").agg(F.min(F.struct("path", "offset")).alias("at"))
    new = first.join(stored, "hash", "left_anti").select("hash", "at.path", "at.offset")
    return chunks.join(new, ["hash", "path", "offset"]).select("hash", "size", "data")


def dedup_ratio(chunks: DataFrame) -> DataFrame:
    """Chunks, distinct contents and their bytes."""
    per = chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    return per.agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("distinct_chunks"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("size").alias("stored_bytes"))


def read_range(chunks: DataFrame, windows: DataFrame) -> DataFrame:
    """(path, data): windows (path, lo, hi) of objects, from their chunks in order."""
    w = chunks.join(windows, "path").where("offset < hi AND offset + size > lo")
    lo = F.greatest(F.col("lo") - F.col("offset"), F.lit(0))
    part = F.substring("data", (lo + 1).cast("int"), (F.least(F.col("size"), F.col("hi") - F.col("offset")) - lo).cast("int"))
    got = w.select("path", "offset", part.alias("part")).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("offset", "part"))).alias("parts"))
    return got.select("path", F.array_join(F.transform("parts", lambda p: F.hex(p["part"])), "").alias("h")).select("path", F.unhex("h").alias("data"))


def clipped(chunks: DataFrame, windows: DataFrame) -> DataFrame:
    """(path, offset, from_byte, to_byte): which bytes of which chunk a read needs."""
    w = chunks.join(windows, "path").where("offset < hi AND offset + size > lo")
    return w.select("path", "offset", F.greatest("lo", "offset").alias("from_byte"), F.least("hi", F.col("offset") + F.col("size")).alias("to_byte"))


def missing(index: DataFrame, stored: DataFrame) -> DataFrame:
    """Referenced contents that the store lacks."""
    return index.select("hash").distinct().join(stored, "hash", "left_anti")


def diff(incoming: DataFrame, local: DataFrame) -> DataFrame:
    """(path, change): added, updated (another size or hash), unchanged or removed."""
    a, b = incoming.select("path", "size", "hash").alias("a"), local.select("path", "size", "hash").alias("b")
    how = F.when(F.col("b.path").isNull(), "added").when(F.col("a.path").isNull(), "removed").when((F.col("a.size") != F.col("b.size")) | (F.col("a.hash") != F.col("b.hash")), "updated").otherwise("unchanged")
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(F.coalesce("a.path", "b.path").alias("path"), how.alias("change"))


def merge(local: DataFrame, upserts: DataFrame, deleted: DataFrame) -> DataFrame:
    """Upserts replace local rows, whatever their sizes; deletions win over both."""
    both = local.select("path", "size", F.lit(0).alias("__new")).unionByName(upserts.select("path", "size", F.lit(1).alias("__new")))
    return both.groupBy("path").agg(F.max_by("size", "__new").alias("size"), F.max("__new").alias("from_upsert")).join(deleted, "path", "left_anti")


def merged_sizes(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """A metadata-only sync: a path's size never shrinks."""
    both = local.select("path", "size").unionByName(incoming.select("path", "size"))
    return both.groupBy("path").agg(F.max("size").alias("size"))


def with_children(directories: DataFrame, index: DataFrame) -> DataFrame:
    """Directories (path) that have an entry directly below."""
    return directories.join(index.select(F.regexp_replace("path", "/?[^/]*$", "").alias("path")).distinct(), "path", "left_semi")


def overwritten(chunks: DataFrame, writes: DataFrame) -> DataFrame:
    """Chunks (path, offset, size, hash) after writes, one a path: what overlaps a write goes, the write comes in."""
    w = writes.select("path", F.col("offset").alias("lo"), (F.col("offset") + F.col("size")).alias("hi"))
    stays = chunks.join(w, "path", "left").where("lo IS NULL OR offset + size <= lo OR offset >= hi").select("path", "offset", "size", "hash")
    return stays.unionByName(writes.where("size > 0").select("path", "offset", "size", "hash"))


def overlaid(chunks: DataFrame, unflushed: DataFrame) -> DataFrame:
    """What a read sees: chunks not yet flushed come before stored ones at the same place."""
    both = chunks.select("path", "offset", "size", "hash", F.lit(0).alias("__new")).unionByName(unflushed.select("path", "offset", "size", "hash", F.lit(1).alias("__new")))
    return both.groupBy("path", "offset").agg(F.max_by(F.struct("size", "hash"), "__new").alias("r")).select("path", "offset", "r.size", "r.hash")


def updated(index: DataFrame, updates: DataFrame) -> DataFrame:
    """(path, size, is_dir) after updates (seq, op, path, size) in order of seq: upsert and mkdir put an entry, delete takes it."""
    last = updates.groupBy("path").agg(F.max_by(F.struct("op", "size"), "seq").alias("u"))
    put = last.where("u.op <> 'delete'").select("path", F.when(F.col("u.op") == "mkdir", F.lit(0)).otherwise(F.col("u.size")).cast("long").alias("size"), (F.col("u.op") == "mkdir").alias("is_dir"))
    return index.select("path", "size", "is_dir").join(last, "path", "left_anti").unionByName(put)


def linked(index: DataFrame, links: DataFrame) -> DataFrame:
    """Hard links (path, target): new entries that refer to the target's content; links to nothing go."""
    return links.join(index.select(F.col("path").alias("target"), "size", "hash"), "target").select("path", "size", "hash")


def removed(index: DataFrame, paths: DataFrame) -> DataFrame:
    """The index without the files of `paths` and the directories among them that are empty."""
    full = with_children(paths.select("path"), index)
    return index.join(paths.join(full, "path", "left_anti"), "path", "left_anti")


def changed_entries(changes: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Live changed paths with their entries; changes of unknown paths go."""
    return changes.where("NOT is_deleted").join(index, changes["path"] == index[key]).select(changes["path"], index["size"])


def children(index: DataFrame, directory: str) -> DataFrame:
    """Entries directly below a directory; a deeper path counts as its first component."""
    rest = F.substring("path", len(directory) + 2, 1 << 30)
    below = index.where(F.col("path").startswith(directory + "/")).select(F.substring_index(rest, "/", 1).alias("name"), F.contains(rest, F.lit("/")).alias("is_dir"))
    return below.groupBy("name").agg(F.max("is_dir").alias("is_dir"))


def renamed(index: DataFrame, old: str, new: str) -> DataFrame:
    """The paths after a rename; a directory takes what is below it along."""
    inside = (F.col("path") == old) | F.col("path").startswith(old + "/")
    return index.select(F.when(inside, F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 30))).otherwise(F.col("path")).alias("path"), "size")


def truncated(chunks: DataFrame, size: int) -> DataFrame:
    """Chunks of files cut to `size` bytes; the chunk at the end shrinks."""
    return chunks.where(F.col("offset") < size).withColumn("size", F.least("size", size - F.col("offset")))


def coalesced_writes(writes: DataFrame, by: list[str], width: int = ordered.WIDTH) -> DataFrame:
    """Contiguous writes (seq, offset, size), in order of seq, as one."""
    p = ordered.previous(writes.withColumn("__end", F.col("offset") + F.col("size")), by, "seq", "__end", "__before", width)
    g = ordered.islands(p, by, "seq", F.col("__before").isNull() | (F.col("offset") != F.col("__before")), "run", width)
    return g.groupBy(*by, "run").agg(F.min("seq").alias("first_seq"), F.min("offset").alias("offset"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("writes"))


def merged_intervals(writes: DataFrame, by: list[str], on: str, width: int = ordered.WIDTH) -> DataFrame:
    """Overlapping or touching intervals (lo, hi), in order of `on` (unique, by lo), as one."""
    p = ordered.running_max(writes, by, on, "hi", "__hi", width, before=True)
    g = ordered.islands(p, by, on, F.col("__hi").isNull() | (F.col("lo") > F.col("__hi")), "run", width)
    return g.groupBy(*by, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("writes"))


def message_batches(chunks: DataFrame, by: str, on: str, size: int, width: int = ordered.WIDTH) -> DataFrame:
    """Chunks of each object in messages of `size`."""
    n = ordered.numbered(chunks, [by], on, "__n", width)
    return n.groupBy(by, F.floor((F.col("__n") - 1) / size).cast("long").alias("message")).agg(F.count(F.lit(1)).alias("chunks"), F.min(on).alias("first"))


def etag(hash_: Column, size: Column) -> Column:
    """Half of the first chunk's hash; an empty object has the MD5 of nothing."""
    return F.when(size == 0, F.md5(F.lit(b""))).otherwise(F.left(hash_, F.lit(32)))


def looked_up(paths: DataFrame, index: DataFrame) -> DataFrame:
    """Asked paths with whether they exist and their size; unknown and null ones have none."""
    found = index.where("path IS NOT NULL").select("path", "size", F.lit(True).alias("__found"))
    return paths.join(found, "path", "left").withColumn("found", F.coalesce("__found", F.lit(False))).drop("__found")


def created(index: DataFrame, paths: DataFrame, directories: bool = False) -> DataFrame:
    """The index with empty entries for paths that it lacks, each once; taken and null paths make none."""
    new = paths.where("path IS NOT NULL").select("path").distinct().join(index, "path", "left_anti")
    return index.select("path", "size", "is_dir").unionByName(new.select("path", F.lit(0).cast("long").alias("size"), F.lit(directories).alias("is_dir")))
