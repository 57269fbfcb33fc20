"""Fill-in-middle transformation of whole texts, by one Aho-Corasick scan for events.

Units are runs of ASCII letters and every other single code point. One automaton over the text's ASCII
classes finds (a) each character at which letters begin or end and (b) the sentinels. Between two such events
the number of units is arithmetic: one for letters, one a character for all else. So the events, with running
sums of units, answer where the k-th unit ends by one binary search, and no list of units is made.

Cuts, form and order follow from a digest of the document's id alone; reruns agree wherever a row lies.

Defined results: null texts are empty; empty texts and those with a sentinel stay plain; rows that share a
doc_id get the same digest, each row its own result; a null doc_id counts as no digits; texts of any length
are read whole, one array of them at a time; bytes that aren't UTF-8 are a code point each; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm.common import chunks, documents, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred: documents that are transformed, and of these the ones with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20

_LETTERS, _OTHERS = "aPSM", " <>"
_CLASS = np.full(128, ord(" "), np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = ord("a")
for _c in "PSM<>":
    _CLASS[ord(_c)] = ord(_c)


def automaton() -> ahocorasick.Automaton:
    """Changes between letters and others (value 0), and sentinels (value 1), over the classes of characters."""
    a = ahocorasick.Automaton()
    for x in _LETTERS:
        for y in _OTHERS:
            a.add_word(x + y, 0)
            a.add_word(y + x, 0)
    for s in (PREFIX, SUFFIX, MIDDLE):
        a.add_word(s, 1)
    a.make_automaton()
    return a


class Units:
    """Units of one text: how many there are, whether it holds a sentinel, and where the k-th ends."""

    def __init__(self, text: str, events: ahocorasick.Automaton) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = _CLASS[np.minimum(points, 127)].tobytes().decode("ascii")
        found = np.fromiter((2 * at + kind for at, kind in events.iter(classes)), np.int64)
        self.sentinel = bool((found & 1).any())
        changes = found[found & 1 == 0] >> 1
        self.start = np.concatenate(([0], changes, [len(text)]))[: len(changes) + 1 + bool(text)]
        length = np.diff(self.start)
        first = int(bool(text) and classes[0] in _LETTERS)
        self.letters = np.arange(len(length)) % 2 != first
        self.units = np.concatenate(([0], np.cumsum(np.where(self.letters, 1, length))))
        self.n = int(self.units[-1])

    def end(self, k: int) -> int:
        """The place behind the k-th unit (0: the beginning)."""
        if k == 0:
            return 0
        r = int(np.searchsorted(self.units, k)) - 1
        return int(self.start[r + 1]) if self.letters[r] else int(self.start[r]) + k - int(self.units[r])


def cut(text: str, key: str, events: ahocorasick.Automaton) -> tuple[int, str, int | None, int | None, str]:
    """n units, form, lengths of prefix and middle in code points, and the output."""
    u = Units(text, events)
    digest = sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or u.sentinel or h3 % 100 >= TRANSFORMED:
        return u.n, "plain", None, None, text
    a, b = (u.end(k) for k in sorted((h1 % (u.n + 1), h2 % (u.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return u.n, "spm", len(prefix), len(middle), "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return u.n, "psm", len(prefix), len(middle), "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def rebuilt(output: str, form: str) -> str:
    """The text that output was made of: no part holds a sentinel, so the first of each kind is the separator."""
    if form == "plain":
        return output
    m = output.index(MIDDLE)
    if form == "psm":
        s = output.index(SUFFIX)
        return output[len(PREFIX) : s] + output[m + len(MIDDLE) :] + output[s + len(SUFFIX) : m]
    p = output.index(PREFIX)
    return output[p + len(PREFIX) : m] + output[m + len(MIDDLE) :] + output[len(SUFFIX) : p]


def fill_in_middle(docs: DataFrame, seed: str = "1") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = automaton()
        for b, texts in chunks(batches):
            keys = (f"{seed}:{'' if i is None else i}" for i in b.column("doc_id").to_pylist())
            n, form, prefix, middle, out = zip(*(cut(t.decode("utf-8", "surrogateescape"), k, events) for t, k in zip(texts, keys)))
            out = [t.encode("utf-8", "surrogateescape") for t in out]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(transform, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(made: DataFrame) -> DataFrame:
    """The rows of fill_in_middle() with the text rebuilt from output and form alone, as restored."""
    columns = [c for c in made.columns if c != "restored"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, outputs in chunks(batches, "output"):
            text = [rebuilt(o.decode("utf-8", "surrogateescape"), f).encode("utf-8", "surrogateescape") for o, f in zip(outputs, b.column("form").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(text, pa.binary())], [*columns, "restored"])

    # as bytes in the exchange with Python: outputs needn't be valid UTF-8
    m = made.select(*columns).withColumn("output", F.col("output").cast("binary"))
    out = m.mapInArrow(join, m.schema.simpleString()[7:-1].replace(":", " ") + ", restored binary")
    return out.withColumn("output", F.col("output").cast("string")).withColumn("restored", F.col("restored").cast("string"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return restored(fill_in_middle(documents(spark, sf_dir))).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


OP12_SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256(concat('1:', doc_id)) AS d FROM documents
), hashed AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM units
), parted AS (
  SELECT *, array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
         array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parted
"""
