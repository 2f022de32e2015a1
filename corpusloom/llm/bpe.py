"""Byte-level BPE over whole texts, by overlapping chunks.

A text is cut into chunks of ``CHUNK`` characters and ``OVERLAP`` more, which the next one
has too. Each chunk is split into pre-tokens on its own. The pattern looks at nothing
behind it, so two neighbours that both end a pre-token at one place agree from there on:
the text is parted at the first such place of each overlap, and the pieces between are
encoded, each from its own chunk. Where neighbours have no such place (a pre-token as long
as an overlap), the text is encoded as one piece. Decoding concatenates the bytes of the ids.

One task takes the chunks of texts of at most ``WHOLE`` characters in turn; those of longer
texts are dealt over tasks, each different chunk once however many copies a text has.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import by_task
from corpusloom.sources.lineage import cut

CHUNK, OVERLAP = 1 << 13, 1 << 9
#: Characters of a text whose chunks one task takes.
WHOLE = 1 << 16
#: Chunks that are cut from a long text at a time.
RUN = 128


@lru_cache(4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a file of ranks, without special tokens."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def edges(chunk: str, at: int, pattern: str, overlap: int) -> tuple[list[int], list[int]]:
    """Where the pre-tokens of a chunk that starts at ``at`` end, in its first and its last ``overlap`` characters.

    The chunk's end is left out, as the text goes on there, and so is any place at which
    the text before would be split otherwise if it ended there."""
    head, tail, before = [at], [], 0
    for m in regex.finditer(pattern, chunk):
        end = m.end()
        if end <= overlap:
            head.append(at + end)
        if len(chunk) - overlap <= end < len(chunk) and [x.end() for x in regex.finditer(pattern, chunk[before:end])] == [end - before]:
            tail.append(at + end)
        before = end
    return head, tail


def parted(found: list[tuple[list[int], list[int]]]) -> list[int] | None:
    """The places at which chunks of a text, given their ``edges`` in order, hand over to the next; nothing if two never agree."""
    out = []
    for (_, tail), (head, _) in zip(found, found[1:], strict=False):
        both = set(tail).intersection(head)
        if not both:
            return None
        out.append(min(both))
    return out


def encode(enc: tiktoken.Encoding, text: str, pattern: str, size: int, overlap: int) -> list[int]:
    """The ids of a text, chunk by chunk."""
    starts = range(0, max(1, len(text) - overlap), size)
    places = parted([edges(text[a : a + size + overlap], a, pattern, overlap) for a in starts]) if len(starts) > 1 else []
    if places is None:
        return enc.encode_ordinary(text)
    bounds = [0, *places, len(text)]
    return [i for a, b in zip(bounds, bounds[1:], strict=False) for i in enc.encode_ordinary(text[a:b])]


def _digest(enc: tiktoken.Encoding, ids: list[int], with_ids: bool) -> tuple:
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest(), *([ids] * with_ids)


def _chunks(text: Column, size: int, overlap: int) -> tuple[Column, Column]:
    """Runs of chunks with their places, and of a run ``at, run`` its chunks with theirs: so a long text isn't counted through for each."""
    part = lambda of, a, n, name: F.struct(a.cast("long").alias("at"), of.substr(a.cast("int") + 1, F.lit(n)).alias(name))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - overlap - 1), F.lit(RUN * size)), lambda a: part(text, a, RUN * size + overlap, "run"))
    run = F.col("run")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(run) - overlap - 1), F.lit(size)), lambda a: part(run, a, size + overlap, "chunk"))
    return runs, chunks


def tokenize(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row, and ``ids`` if asked.

    ``ids_sha256`` is over the decimal ids joined by commas, ``decoded_sha256`` over the
    bytes that the ids decode to. Null texts count as empty: no ids. Rows keep their
    doc_id even if it is null or repeated; an empty table gives an empty result; other
    columns don't matter. The ids of one text meet in one task, its chunks don't.
    """
    by_task(docs.sparkSession)
    size, overlap = CHUNK, OVERLAP
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names, kinds = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids, [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * with_ids

    def per_text(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            rows = [_digest(enc, encode(enc, t, pattern, size, overlap), with_ids) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], [batch.schema.names[0], *names])

    def per_chunk(batches):
        for batch in batches:
            found = [edges(t, a, pattern, overlap) for a, t in zip(batch["at"].to_pylist(), batch["chunk"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1))], [*batch.schema.names, "head", "tail"])

    def hand_over(batches):
        for batch in batches:
            got = [parted([(c["head"], c["tail"]) for c in row]) for row in batch["chunks"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(got, pa.list_(pa.int64()))], ["key", "places"])

    def per_piece(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("chunk", "at", "first", "end")), strict=True)
            ids = [enc.encode_ordinary(t[a - at : len(t) if b is None else b - at]) for t, at, a, b in rows]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["at"], pa.array(ids, pa.list_(pa.int32()))], ["key", "at", "piece"])

    def per_ids(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            rows = [_digest(enc, ids, with_ids) for ids in batch["all"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["key", *names])

    short = docs.where(F.length("text") <= WHOLE).mapInArrow(per_text, f"doc_id long, {schema}")
    long = docs.where(F.length("text") > WHOLE).withColumn("key", F.sha2("text", 256))
    runs, chunks = _chunks(F.col("text"), size, overlap)
    cuts = long.select("key", F.explode(runs).alias("r")).select("key", F.col("r.at").alias("run_at"), "r.run").select("key", "run_at", F.explode(chunks).alias("c"))
    cuts = cuts.select("key", (F.col("run_at") + F.col("c.at")).alias("at"), "c.chunk").dropDuplicates(["key", "at"])
    parts = cut(cuts.mapInArrow(per_chunk, "key string, at long, chunk string, head array<long>, tail array<long>"))
    places = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "head", "tail"))).alias("chunks")).mapInArrow(hand_over, "key string, places array<long>")
    places = cut(places)
    # each chunk encodes from where the one before hands over to where it does itself
    k = F.col("i")
    pieces = parts.join(places.where("places is not null"), "key").withColumn("i", (F.col("at") / size).cast("int"))
    pieces = pieces.withColumn("first", F.when(k > 0, F.try_element_at("places", k)).otherwise(F.lit(0).cast("long"))).withColumn("end", F.try_element_at("places", k + 1))
    done = pieces.select("key", "at", "chunk", "first", "end").mapInArrow(per_piece, "key string, at long, piece array<int>")
    done = done.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x.piece)).alias("all")).mapInArrow(per_ids, f"key string, {schema}")
    rest = long.join(places.where("places is null").select("key"), "key", "left_semi").dropDuplicates(["key"]).select("key", "text").mapInArrow(per_text, f"key string, {schema}")
    return short.unionByName(long.select("doc_id", "key").join(done.unionByName(rest), "key").drop("key"))
