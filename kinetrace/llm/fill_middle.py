"""Fill-in-the-middle: a text is cut twice between units and its parts are put in another order, behind marks.

Run-length class encoding: a text is kept as maximal runs of code points of one class, white space or the length in bytes of a
code point, with the units and code points up to the end of each run. The run that holds a cut is found by binary search in the
unit counts, and the cut's place in the text by arithmetic, since all code points of a run are equally long. All texts of a batch
share one such table. No text is split into a list of its units.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinetrace.llm.workspace import runs, working_on
from kinetrace.session import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that are encoded as runs at once.
RUN_BYTES = 4 << 20
SPACE = 5
#: Class of a code point by its first byte: its length in bytes, or SPACE; bytes within a code point have none.
CLASSES = np.zeros(256, np.uint8)
CLASSES[:0x80], CLASSES[0xC0:0xE0], CLASSES[0xE0:0xF0], CLASSES[0xF0:] = 1, 2, 3, 4
CLASSES[[0x20, *range(0x09, 0x0E)]] = SPACE


@dataclass
class ClassRuns:
    """The runs of some texts that lie one after another in ``data``; text k has bytes ``bounds[k]`` to ``bounds[k + 1]``."""

    start: np.ndarray  # first byte of a run
    width: np.ndarray  # bytes of each of its code points
    points: np.ndarray  # code points up to its end, of all texts before too
    units: np.ndarray  # units up to its end, of all texts before too
    bounds: np.ndarray
    base_points: np.ndarray  # code points, units before each text, and of all
    base_units: np.ndarray
    by_token: bool

    @classmethod
    def of(cls, data: np.ndarray, bounds: np.ndarray, unit: str) -> ClassRuns:
        kind = CLASSES[data]
        leads = np.flatnonzero(kind)
        kind = kind[leads]
        firsts = np.searchsorted(leads, bounds)  # code point at which each text begins
        new = np.empty(len(kind), bool)
        new[:1], new[1:] = True, kind[1:] != kind[:-1]
        inner = firsts[:-1][firsts[:-1] < firsts[1:]]
        new[inner] = True
        at = np.flatnonzero(new)
        points = np.append(at[1:], len(kind)) if len(at) else at
        kind_of, last = kind[at], np.zeros(len(at), bool)
        last[np.searchsorted(points, firsts[1:][firsts[:-1] < firsts[1:]])] = True
        if unit == "token":
            before_space = np.append(kind_of[1:] == SPACE, False)[: len(at)]
            units = np.cumsum(last | ((kind_of != SPACE) & before_space))
        elif unit == "char":
            units = points
        else:
            raise ValueError(f"unknown unit {unit!r}")
        runs_before = np.searchsorted(at, firsts)
        upto = np.concatenate([[0], units])
        return cls(leads[at], np.where(kind_of == SPACE, 1, kind_of), points, units, bounds, firsts, upto[runs_before], unit == "token")

    @property
    def counts(self) -> np.ndarray:
        """Units of each text."""
        return np.diff(self.base_units)

    def places(self, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and code points of each text before its cut, which lies after ``cuts[k]`` units."""
        byte, point = np.zeros(len(cuts), np.int64), np.zeros(len(cuts), np.int64)
        k = np.flatnonzero(cuts > 0)
        goal = self.base_units[k] + cuts[k]
        run = np.searchsorted(self.units, goal)
        # a token ends with its run; of code points as many as the cut asks for are taken from the run
        back = 0 if self.by_token else self.units[run] - goal
        upto = self.points[run] - back
        begin = np.where(run > 0, self.points[run - 1], 0)
        byte[k] = self.start[run] + (upto - begin) * self.width[run] - self.bounds[k]
        point[k] = upto - self.base_points[k]
        return byte, point


def _text_runs(texts: pa.Array, unit: str) -> tuple[memoryview, ClassRuns]:
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return memoryview(held), ClassRuns.of(held, bounds - bounds[0], unit)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "token", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """One row per input row: ``id_col, n, form, prefix_chars, middle_chars, output``.

    ``n`` counts the units: tokens (white space and the word behind it; white space at the end is one of its own) or code points
    (``unit="char"``). Cuts and form hang on ``seed`` and the id alone: of 100 texts about ``rate`` are rearranged, of these
    about ``spm`` suffix first. A null text counts as empty; a null id counts as an empty one in the hash and stays null. Empty texts and texts with
    a mark of their own are ``plain``: the output is the text, and the two counts are null. Rows that repeat an id are cut by the same numbers.
    A text is held whole, with about 20 bytes for each of its bytes, in one task. An empty table gives an empty result; other columns are ignored.
    """
    given = T.StructType.fromDDL("_id string, n long, form string, prefix_chars long, middle_chars long, output binary")
    arrow = to_arrow_schema(given)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def rearranged(text: bytes, first: int, second: int, form: str) -> bytes:
        (p, s, m), prefix, middle, suffix = marks, text[:first], text[first:second], text[second:]
        return b"".join((s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on("fill_middle")
        for batch in batches:
            for run in runs(batch, "_text", RUN_BYTES):
                data, table_ = _text_runs(run.column("_text"), unit)
                n, bounds = table_.counts, table_.bounds.tolist()
                h = np.array([[int(x[k : k + 8], 16) for k in (0, 8, 16, 24)] for x in run.column("_hash").to_pylist()], np.int64).reshape(-1, 4)
                one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
                (first, prefix), (second, upto) = table_.places(np.minimum(one, two)), table_.places(np.maximum(one, two))
                forms, outputs = [], []
                for k, (plain, suffix_first) in enumerate(zip((h[:, 2] % 100 >= rate).tolist(), (h[:, 3] % 100 < spm).tolist(), strict=True)):
                    text = bytes(data[bounds[k] : bounds[k + 1]])
                    form = "plain" if plain or not text or any(m in text for m in marks) else "spm" if suffix_first else "psm"
                    forms.append(form)
                    outputs.append(text if form == "plain" else rearranged(text, int(first[k]), int(second[k]), form))
                mask = np.array([f == "plain" for f in forms], bool)
                columns = [run.column("_id"), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64(), mask=mask), pa.array(upto - prefix, pa.int64(), mask=mask), pa.array(outputs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    id_type = docs.schema[id_col].dataType
    id_text = F.col(id_col).cast("string")
    rows = docs.select(id_text.alias("_id"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))), 256).alias("_hash"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = rows.mapInArrow(transform, given)
    return out.select(F.col("_id").cast(id_type).alias(id_col), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A mark is the first of its kind, since no part holds one."""
    between = lambda a, b: F.substring(output, a, b - a)
    rest = lambda a: F.substring(output, a, F.lit(2**31 - 1))
    p, s, m = (F.locate(mark, output) for mark in (PREFIX, SUFFIX, MIDDLE))
    behind = F.lit(len(PREFIX))
    psm = F.concat(between(behind + 1, s), rest(m + behind), between(s + behind, m))
    spm = F.concat(between(p + behind, m), rest(m + behind), between(behind + 1, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
TOKENS = r"'[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'"
ORACLES = {
    "op11_fill_in_middle": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), {TOKENS}) AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM p"""
}
