r"""Fill-in-the-middle transformation of texts.

A text is cut twice, at unit counts drawn by hash, and its parts are put in another order. Where
a cut lies is found by a Fenwick tree over fixed blocks of the text, whose nodes hold units
and code points: a descent by binary lifting finds the block of a cut, and only that block
is searched for the place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.arrow import batches

BLOCK = 4096           # code points
SEED = 1
PLAIN_FROM, SPM_BELOW = 90, 20      # of 100

# fixed values: the marks of the parts
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_COLUMNS = "n long, form string, prefix_chars long, middle_chars long, output string"
_SCHEMA = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
           ("output", pa.string())]


class Fenwick:
    """Sums of units and code points over the first blocks of a text."""

    def __init__(self, sums: np.ndarray):
        """``sums``: one row of units and code points per block."""
        self.size = len(sums)
        self.nodes = np.zeros((self.size + 1, 2), np.int64)
        self.nodes[1:] = sums
        for i in range(1, self.size + 1):
            above = i + (i & -i)
            if above <= self.size:
                self.nodes[above] += self.nodes[i]

    def find(self, units: int) -> tuple[int, int, int]:
        """Number of whole blocks that hold at most ``units`` units, with their units and code points."""
        at, seen, chars = 0, 0, 0
        for k in range(self.size.bit_length() - 1, -1, -1):
            step = at + (1 << k)
            if step <= self.size and seen + self.nodes[step, 0] <= units:
                at, seen, chars = step, seen + int(self.nodes[step, 0]), chars + int(self.nodes[step, 1])
        return at, seen, chars


class Units:
    """Units of a text, ``[A-Za-z]+|[^A-Za-z]`` from left to right, counted by block."""

    def __init__(self, text: str, block: int = BLOCK):
        self.text, self.block = text, block
        starts = range(0, len(text), block)
        self.tree = Fenwick(np.array([(len(self._begins(at)), min(block, len(text) - at)) for at in starts], np.int64).reshape(-1, 2))
        self.n = self.tree.find(len(text))[1]

    def _begins(self, at: int) -> np.ndarray:
        """Places in the block at ``at`` where units begin."""
        part = np.frombuffer(self.text[max(at - 1, 0):at + self.block].encode("utf-32-le", "surrogatepass"), np.uint32)
        folded = part | 32
        letter = (folded >= 97) & (folded <= 122)
        begins = np.ones(len(part), bool)
        begins[1:] = ~(letter[1:] & letter[:-1])
        return np.flatnonzero(begins[1:] if at else begins)

    def place(self, units: int) -> int:
        """Code points before the unit of that number, the whole text if there is none."""
        number, before, chars = self.tree.find(units)
        if number == self.tree.size:
            return len(self.text)
        return chars + int(self._begins(number * self.block)[units - before])


def transform(text: str, name: str, block: int = BLOCK) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, prefix and middle length and output of one text with id ``name``."""
    units = Units(text, block)
    n = units.n
    drawn = hashlib.sha256(f"{SEED}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or h3 % 100 >= PLAIN_FROM or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (units.place(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output`` of every row.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Null and empty texts are
    plain; a null id draws as an empty name. Each row is taken by itself, so repeated rows give
    equal rows and an empty table none. Long texts are read block by block: beside the text and
    its output a task holds one block's code points and two numbers per block.
    """
    def rows(source: Iterator[pa.RecordBatch]):
        for batch in source:
            for doc, text in zip(batch.column(0), batch.column(1)):
                name, text = doc.as_py(), text.as_py() or ""
                yield (name, *transform(text, "" if name is None else str(name), block)), 60 + 2 * len(text)

    kind = docs.schema["doc_id"].dataType.simpleString()

    def mapped(source: Iterator[pa.RecordBatch]):
        first = next(source, None)
        if first is None:
            return
        schema = pa.schema([("doc_id", first.schema.field(0).type), *_SCHEMA])
        yield from batches(rows(_chain(first, source)), schema)

    return docs.select("doc_id", "text").mapInArrow(mapped, f"doc_id {kind}, {_COLUMNS}")


def _chain(first, rest):
    yield first
    yield from rest


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    A transformed text holds none of the marks, and no mark ends as another begins, so the three
    in an output are the only ones.
    """
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
