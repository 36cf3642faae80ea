"""Fill-in-middle by one NumPy kernel over the Arrow buffers of a whole batch.

A text is cut between lines into prefix, middle and suffix, and put in the order prefix,
suffix, middle (psm) or suffix, prefix, middle (spm) with a sentinel before each. The
kernel never takes a text apart on its own: a byte's class tells line feeds, heads of
code points and the bytes of sentinels; the mask of bytes that follow a line feed or
begin a document marks where lines begin; sums of the mask, counted anew from each
document's start, number the lines; and one search in these sums finds the cuts of all
rows. Cuts become offsets of one Arrow array over the batch's own bytes, so prefixes,
middles and suffixes are views of them until they are joined.

Sums run over windows of some MB and carry on, so a very long text takes no more memory
than its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .textops import small_batches, unused

#: Fixed values of the format.
PREFIX, SUFFIX, MIDDLE, NOTHING = (pa.scalar(x, pa.large_binary()) for x in (b"<P>", b"<S>", b"<M>", b""))
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Classes of bytes: heads of code points, line feeds, and the three bytes of a sentinel.
HEAD, FEED, OPEN, NAME, SHUT = 1, 2, 4, 8, 16
CLASS = np.zeros(256, np.uint8)
CLASS[[b for b in range(256) if b & 0xC0 != 0x80]] = HEAD
for _bytes, _class in ((b"\n", FEED), (b"<", OPEN), (b"PSM", NAME), (b">", SHUT)):
    CLASS[list(_bytes)] |= _class
#: Bytes that one run of the kernel takes on, and of a window of sums.
SLICE, WINDOW = 8 << 20, 2 << 20
MADE = ["n", "form", "prefix_chars", "middle_chars", "output"]


def hashed(seed: int) -> list[Column]:
    """h1 to h4 of doc_id: the first four groups of eight digits of the sha256 of `seed:doc_id`; a null id is the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(bytes, offsets, array) of texts; the offsets count from the first byte, and a null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0], column


class Sums:
    """Counts of line beginnings and code points before any place of a batch, by windows of its bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.begins = offsets[:-1][np.diff(offsets) > 0]
        self.edges = np.arange(0, max(len(data), 1) + WINDOW, WINDOW)
        self.held: tuple[int, np.ndarray, np.ndarray] | None = None
        lines, heads = [0], [0]
        for w in range(len(self.edges) - 1):
            _, line, head = self.window(w)
            lines.append(lines[-1] + int(line[-1]))
            heads.append(heads[-1] + int(head[-1]))
        #: Of each kind, what lies before each window.
        self.lines, self.heads = np.array(lines), np.array(heads)

    def window(self, w: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(w, sums of line beginnings, sums of heads) within a window, each one longer than it."""
        if self.held is None or self.held[0] != w:
            at, end = self.edges[w], min(self.edges[w + 1], len(self.data))
            kinds = CLASS[self.data[at:end]]
            starts = np.zeros(end - at, bool)
            starts[1:] = kinds[:-1] & FEED
            if at and end > at:
                starts[0] = CLASS[self.data[at - 1]] & FEED
            first = np.searchsorted(self.begins, [at, end])
            starts[self.begins[first[0] : first[1]] - at] = True
            sums = np.zeros((2, end - at + 1), np.int32)
            np.cumsum(starts, out=sums[0, 1:])
            np.cumsum(kinds & HEAD, out=sums[1, 1:])
            self.held = w, sums[0], sums[1]
        return self.held

    def before(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Line beginnings and code points before each place."""
        out = np.zeros((2, len(places)), np.int64)
        of = np.minimum(places // WINDOW, len(self.edges) - 2)
        for w in np.unique(of):
            mine = np.flatnonzero(of == w)
            _, line, head = self.window(int(w))
            out[0, mine] = self.lines[w] + line[places[mine] - self.edges[w]]
            out[1, mine] = self.heads[w] + head[places[mine] - self.edges[w]]
        return out[0], out[1]

    def line(self, k: np.ndarray) -> np.ndarray:
        """Where the k-th line of the batch (from 0) begins."""
        out = np.zeros(len(k), np.int64)
        of = np.searchsorted(self.lines, k, side="right") - 1
        for w in np.unique(of):
            mine = np.flatnonzero(of == w)
            sums = self.window(int(w))[1]
            out[mine] = self.edges[w] + np.searchsorted(sums, k[mine] - self.lines[w] + 1) - 1
        return out


def sentinels(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, document) of each sentinel that lies in one document."""
    found = []
    for at in range(0, max(0, len(data) - 2), WINDOW):
        kinds = CLASS[data[at : at + WINDOW + 2]]
        opens = np.flatnonzero(kinds[:-2] & OPEN)
        found.append(at + opens[((kinds[opens + 1] & NAME) > 0) & ((kinds[opens + 2] & SHUT) > 0)])
    places = np.concatenate(found) if found else np.zeros(0, np.int64)
    docs = np.searchsorted(offsets, places, side="right") - 1
    whole = places + 3 <= offsets[docs + 1]
    return places[whole], docs[whole]


def thirds(data: np.ndarray, cuts: np.ndarray) -> tuple[pa.Array, ...]:
    """Arrays of the bytes between neighbouring columns of cuts (one row a document), as views of the data."""
    shared = pa.py_buffer(data)
    return tuple(
        pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(cuts), [None, pa.py_buffer(np.ascontiguousarray(np.append(cuts[:, k : k + 2].ravel(), len(data)))), shared]).take(pa.array(np.arange(0, 2 * len(cuts), 2)))
        for k in range(cuts.shape[1] - 1)
    )


def chosen(form: np.ndarray, of: dict[str, pa.Array]) -> pa.Array:
    """For each row the value of its form."""
    return pc.if_else(pa.array(form == PLAIN), of[PLAIN], pc.if_else(pa.array(form == PSM), of[PSM], of[SPM]))


def infilled(column: pa.Array, h: np.ndarray, rate: int, spm: int) -> dict[str, pa.Array]:
    """The columns MADE for texts and their four hashes (4 x rows)."""
    data, offsets, texts = bytes_of(column)
    sums = Sums(data, offsets)
    lines, heads = sums.before(offsets)
    n = np.diff(lines)
    marked = np.zeros(len(n), bool)
    marked[sentinels(data, offsets)[1]] = True
    plain = (n == 0) | marked | (h[2] % 100 >= rate)
    form = np.where(plain, PLAIN, np.where(h[3] % 100 < spm, SPM, PSM)).astype(object)
    places = [offsets[:-1]]
    for cut in np.sort(h[:2] % (n + 1), axis=0):
        inner = cut < n
        place = offsets[1:].copy()
        place[inner] = sums.line((lines[:-1] + cut)[inner])
        places.append(place)
    chars = np.stack([sums.before(p)[1] for p in places])
    prefix, middle, suffix = thirds(data, np.column_stack([*places, offsets[1:]]))
    output = chosen(form, {
        PLAIN: texts,
        PSM: pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, NOTHING),
        SPM: pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, NOTHING),
    })
    count = lambda x: pa.array(x, pa.int64(), mask=plain)
    made = (pa.array(n, pa.int64()), pa.array(form, pa.string()), count(chars[1] - chars[0]), count(chars[2] - chars[1]), output.cast(pa.string()))
    return dict(zip(MADE, made))


def rebuilt(column: pa.Array, form: np.ndarray) -> pa.Array:
    """The texts that outputs of these forms were made of, by the sentinels of all rows at once."""
    data, offsets, outputs = bytes_of(column)
    places, docs = sentinels(data, offsets)
    framed = form != PLAIN
    mine = framed[docs]
    # such an output has three sentinels: one at its start, and none but these
    cuts = np.repeat(offsets[:-1, None], 3, axis=1)
    cuts[framed] = places[mine].reshape(-1, 3)
    ends = np.column_stack([cuts[:, 1:], offsets[1:]])
    parts = [thirds(data, np.column_stack([np.minimum(cuts[:, k] + 3, ends[:, k]), ends[:, k]]))[0] for k in range(3)]
    first, second, middle = parts
    return chosen(form, {
        PLAIN: outputs,
        PSM: pc.binary_join_element_wise(first, middle, second, NOTHING),
        SPM: pc.binary_join_element_wise(second, middle, first, NOTHING),
    }).cast(pa.string())


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about SLICE bytes of a column; a longer text is a run of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, side="right")))
        yield batch.slice(at, end - at)
        at = end


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output, the text in fill-in-middle form.

    n lines (`[^\\n]*\\n|[^\\n]+`) are cut at two of the n+1 places between them, drawn by
    hashes of seed and doc_id, so a rerun draws the same; a middle may be empty. Of 100
    texts `rate` are put in a form, of these `spm` of 100 in spm. An empty or null text, one
    that has a sentinel itself, and the rest keep the text: form plain, chars null. Rows
    of one doc_id draw the same hashes; a null doc_id is the empty text to the hash. Other
    columns, whatever their names, pass through; columns of the made names are replaced.
    An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*MADE).withColumn("text", F.col("text").cast("string"))
    drawn = unused(docs, *(f"h{k}" for k in range(1, 5)))
    schema = "n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                h = np.stack([b.column(c).to_numpy() for c in drawn])
                made = infilled(b.column("text"), h, rate, spm)
                kept = [c for c in b.schema.names if c not in drawn]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *made.values()], [*kept, *made])

    return docs.select("*", *(h.alias(c) for c, h in zip(drawn, hashed(seed)))).mapInArrow(run, schema_with(docs, schema))


def schema_with(df: DataFrame, more: str) -> StructType:
    """df's schema and the columns of a DDL text after it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def restored(filled: DataFrame) -> DataFrame:
    """filled with column text, rebuilt from output and form alone; a null output or form gives an empty text or the output."""
    filled = filled.drop("text")

    def run(batches):
        for whole in batches:
            for b in slices(whole, "output"):
                form = pc.fill_null(b.column("form"), PLAIN).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*b.columns, rebuilt(b.column("output"), form)], [*b.schema.names, "text"])

    return filled.mapInArrow(run, schema_with(filled, "text string"))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row of documents."""
    made = restored(fill_in_middle(docs.select("doc_id", "text")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


#: DuckDB's twin of digest().
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
  ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(lines)::BIGINT AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(lines[1:a], ''), '') AS prefix, coalesce(array_to_string(lines[a + 1:b], ''), '') AS middle, coalesce(array_to_string(lines[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
