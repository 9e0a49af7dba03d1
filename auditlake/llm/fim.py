"""Fill-in-middle transformation by in-place block rotation.

A text is cut into prefix, middle and suffix at ends of lines. Its bytes go into one buffer with a sentinel before each part; the parts
change places by rotations of neighbouring blocks, each made of three reversals within the buffer. The way back finds the sentinels and
rotates the other way, so it needs nothing but the output and the form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm import texts

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Settings:
    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"
    #: Percent of the texts that are transformed, and of these the percent with the suffix in front.
    rate: int = 100
    spm: int = 50
    seed: int = 7

    @property
    def sentinels(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix, self.suffix, self.middle


def _reverse(buffer: np.ndarray, start: int, end: int) -> None:
    """Reverse ``buffer[start:end]`` by exchanging its halves, a bounded slice at a time."""
    step = 1 << 16
    while end - start > 1:
        n = min(step, (end - start) // 2)
        left = buffer[start : start + n].copy()
        buffer[start : start + n] = buffer[end - n : end][::-1]
        buffer[end - n : end] = left[::-1]
        start, end = start + n, end - n


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange the blocks ``[start:cut]`` and ``[cut:end]`` in place."""
    view = np.frombuffer(buffer, np.uint8)
    _reverse(view, start, cut)
    _reverse(view, cut, end)
    _reverse(view, start, end)


def _draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def _line_end(text: bytes, lines: int) -> int:
    """Offset after so many lines."""
    if not lines:
        return 0
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
    return int(ends[lines - 1]) + 1 if lines <= len(ends) else len(text)


def _characters(text: bytes | bytearray, start: int, end: int) -> int:
    return end - start - int(np.count_nonzero((np.frombuffer(text, np.uint8, end - start, start) & 0xC0) == 0x80))


def transform_text(doc_id: int | None, text: bytes, s: Settings = Settings()) -> tuple[int, str, int | None, int | None, bytes]:
    """Lines, form, characters of prefix and middle, and the output."""
    n = text.count(b"\n") + (not text.endswith(b"\n") and text != b"")
    h1, h2, h3, h4 = _draws(doc_id, s.seed)
    if not text or h3 % 100 >= s.rate or any(x in text for x in s.sentinels):
        return n, PLAIN, None, None, text
    a, b = (_line_end(text, x) for x in sorted((h1 % (n + 1), h2 % (n + 1))))
    out = bytearray(text)
    for at, sentinel in ((b, s.suffix), (a, s.middle), (0, s.prefix)):  # from the end, so that earlier cuts stay valid
        out[at:at] = sentinel
    middle = a + len(s.prefix)
    suffix = b + len(s.prefix) + len(s.middle)
    form = SPM if h4 % 100 < s.spm else PSM
    rotate(out, 0 if form == SPM else middle, suffix, len(out))
    return n, form, _characters(text, 0, a), _characters(text, a, b), bytes(out)


def restore_text(output: bytes, form: str, s: Settings = Settings()) -> bytes:
    """The text that ``output`` was made from."""
    if form == PLAIN:
        return output
    back = bytearray(output)
    suffix, middle, prefix = (back.find(x) for x in (s.suffix, s.middle, s.prefix))
    if form == SPM:  # suffix, prefix, middle
        size = prefix - suffix
        rotate(back, 0, size, len(back))
        middle, suffix = middle - size, len(back) - size
    else:  # prefix, suffix, middle
        size = len(back) - middle
        rotate(back, suffix, middle, len(back))
        middle, suffix = suffix, suffix + size
    for at, sentinel in ((suffix, s.suffix), (middle, s.middle), (0, s.prefix)):
        del back[at : at + len(sentinel)]
    return bytes(back)


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transformed(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` per row of ``docs (doc_id, text)``.

    ``n`` counts lines; cuts and form are drawn from the id, so reruns and repeated rows agree. Null and empty texts, and texts that hold a
    sentinel, are ``plain``: the output is the text (empty for null) and the two lengths are null. A null id draws like an empty one. A text
    without line end is one line: a part takes all of it. Other columns are ignored; an empty table gives no rows.
    """

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                rows = [transform_text(i, t or b"", s) for i, t in zip(batch["doc_id"].to_pylist(), texts.utf8(batch["text"]), strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                     pa.array(output, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(transform, _OUT)


def restored(output: Column | str, form: Column | str, s: Settings = Settings()) -> Column:
    """The text of an output and its form; null outputs stay null."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else restore_text(o.encode(), f, s).decode() for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return back(output, form)


def digests(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """:func:`transformed` with SHA-256 digests of the output and of the text restored from it, in their place."""
    out = transformed(docs, s)
    sums = [F.sha2(x.cast("binary"), 256).alias(name) for x, name in ((F.col("output"), "output_sha256"), (restored("output", "form", s), "restored_sha256"))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *sums)


def digests_sql(s: Settings = Settings()) -> str:
    """:func:`digests` in DuckDB."""
    p, f, m = (x.decode() for x in s.sentinels)
    return f"""
with a as (
  select doc_id, coalesce(text, '') as t, string_split(coalesce(text, ''), chr(10)) as parts,
    sha256('{s.seed}:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
b as (select *, cast(len(parts) - case when ends_with(t, chr(10)) or t = '' then 1 else 0 end as bigint) as n,
    {', '.join(f"cast('0x' || substr(h, {1 + 8 * i}, 8) as bigint) as h{i + 1}" for i in range(4))} from a),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as i, greatest(h1 % (n + 1), h2 % (n + 1)) as j,
    case when t = '' or contains(t, '{p}') or contains(t, '{f}') or contains(t, '{m}') or h3 % 100 >= {s.rate} then 'plain'
      when h4 % 100 < {s.spm} then 'spm' else 'psm' end as form from b),
d as (select *, {', '.join(f"case when {x} = 0 then 0 when {x} = n then length(t) else length(array_to_string(parts[1:{x}], chr(10))) + 1 end as e{x}" for x in 'ij')} from c),
e as (select *, substr(t, 1, ei) as p, substr(t, ei + 1, ej - ei) as m, substr(t, ej + 1) as s from d)
select doc_id, n, form, cast(case when form <> 'plain' then length(p) end as bigint) as prefix_chars, cast(case when form <> 'plain' then length(m) end as bigint) as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '{p}' || p || '{f}' || s || '{m}' || m else '{f}' || s || '{p}' || p || '{m}' || m end) as output_sha256,
  sha256(t) as restored_sha256 from e"""
