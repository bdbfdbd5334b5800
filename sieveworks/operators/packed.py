"""Several values packed in one field, split into one value per row.

The scan works on the byte buffer of an Arrow string array: quote parity is a
running sum of quote bytes per value, delimiter bytes are masked where the
parity is even, and the masked positions become child offsets over the same
buffer. The members are taken from it as an Arrow array, trimmed and unquoted as
a whole, and flattened with the ordinals of their parents.

Delimiters: ``;`` ``|`` line feed, tab and the full-width ``；`` ``、``
always; ``+`` ``&`` ``/`` between blanks; a comma before a blank, after a
quoted value, or between blanks. A delimiter inside double quotes belongs to
the value. A value wrapped in ``[`` and ``]`` around quoted members is read as
a list; only lists with escapes are decoded one by one. Null, blank and empty
fields give no rows; empty members don't count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Blanks that are trimmed from both ends of a member.
BLANKS = " \t\r\n\f\v\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u2060\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200E)))

_ALWAYS = np.zeros(256, bool)
_ALWAYS[[ord(c) for c in ";|\n\t"]] = True
_SPACED = np.zeros(256, bool)
_SPACED[[ord(c) for c in "+&/"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in " \t\r\n"]] = True
#: Three-byte delimiters by their bytes.
_WIDE = [tuple(c.encode()) for c in "；、"]


def cleaned(members: pa.Array) -> pa.Array:
    """Members without outer blanks and enclosing quotes, doubled quotes undone."""
    members = pc.utf8_trim(members, characters=BLANKS)
    quoted = pc.and_(pc.and_(pc.starts_with(members, '"'), pc.ends_with(members, '"')), pc.greater_equal(pc.utf8_length(members), 2))
    if not pc.any(quoted, skip_nulls=True).as_py():
        return members
    inner = pc.utf8_trim(pc.replace_substring(pc.utf8_slice_codeunits(members, 1, -1), '""', '"'), characters=BLANKS)
    return pc.if_else(quoted, inner, members)


def _lists(values: pa.Array) -> tuple[pa.Array, dict[int, list[str]]]:
    """Values with the brackets of lists taken off, and the members of lists with escapes by place."""
    bare = pc.utf8_trim(values, characters=BLANKS)
    listed = pc.and_(pc.starts_with(bare, "["), pc.ends_with(bare, "]"))
    if not pc.any(listed).as_py():
        return values, {}
    inner = pc.utf8_slice_codeunits(bare, 1, -1)
    listed = pc.and_(listed, pc.starts_with(pc.utf8_ltrim(inner, characters=BLANKS), '"'))
    escaped: dict[int, list[str]] = {}
    for i in np.flatnonzero(pc.and_(listed, pc.match_substring(inner, "\\")).to_numpy(zero_copy_only=False)):
        try:
            got = json.loads(bare[i].as_py())
            if all(isinstance(x, str) for x in got):
                escaped[int(i)] = [y for x in got if (y := x.strip(BLANKS))]
        except ValueError:
            pass
    return pc.if_else(listed, inner, values), escaped


def _wide_blanks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where blanks of two or three bytes begin and end: no-break, typographic, zero-width and ideographic ones."""
    two = np.concatenate([data[1:], [0]])
    three = np.concatenate([two[1:], [0]])
    short = (data == 0xC2) & ((two == 0xA0) | (two == 0x85))
    long = (two == 0x80) & (((data == 0xE2) & (((three >= 0x80) & (three <= 0x8D)) | (three == 0xAF))) | ((data == 0xE3) & (three == 0x80)))
    ends = np.zeros(len(data), bool)
    ends[np.flatnonzero(short) + 1] = True
    ends[np.flatnonzero(long) + 2] = True
    return short | long, ends


def delimiters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and byte widths of the delimiters outside quotes.

    data: the bytes of all values on end; offsets: n+1 bounds of the values.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    quote = data == 34
    run = np.concatenate([[0], np.cumsum(quote)])
    starts = np.repeat(run[offsets[:-1]], np.diff(offsets))
    outside = ((run[:-1] - starts) & 1) == 0
    prev = np.concatenate([[32], data[:-1]])
    after = np.concatenate([data[1:], [32]])
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    last = np.zeros(n, bool)
    ends = offsets[1:] - 1
    last[ends[(ends >= 0) & (np.diff(offsets) > 0)]] = True
    begins, finishes = _wide_blanks(data)
    before_blank = _SPACE[prev] | first | np.concatenate([[False], finishes[:-1]])
    after_blank = _SPACE[after] | last | np.concatenate([begins[1:], [False]])
    comma = (data == 44) & (after_blank | before_blank | (prev == 34) | (after == 34))
    hit = _ALWAYS[data] | (_SPACED[data] & before_blank & after_blank) | comma
    width = np.ones(n, np.int64)
    for a, b, c in _WIDE:
        at = np.flatnonzero(data == a)
        at = at[at + 2 < n]
        at = at[(data[at + 1] == b) & (data[at + 2] == c)]
        hit[at] = True
        width[at] = 3
    at = np.flatnonzero(hit & outside)
    return at, width[at]


def split_array(values: pa.Array) -> pa.ListArray:
    """A list array of the cleaned, non-empty members of each value; null gives an empty list."""
    values = values.cast(pa.large_string())
    if values.null_count:
        values = values.fill_null("")
    values, escaped = _lists(values)
    n = len(values)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1] if n else np.zeros(1, np.int64)
    body = values.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    cuts, widths = delimiters(data, offsets)
    # members and what stands between them take turns in the buffer
    starts, ends = np.sort(np.concatenate([offsets[:-1], cuts + widths])), np.sort(np.concatenate([cuts, offsets[1:]]))
    bounds = np.empty(2 * len(starts), np.int64)
    bounds[::2], bounds[1::2] = starts, ends
    n_cuts = np.diff(np.searchsorted(cuts, offsets))
    parent = np.repeat(np.arange(n), n_cuts + 1)
    both = pa.LargeStringArray.from_buffers(max(len(bounds) - 1, 0), pa.py_buffer(bounds), pa.py_buffer(data))
    members = cleaned(both.take(pa.array(np.arange(0, len(both), 2))))
    keep = pc.greater(pc.binary_length(members), 0).to_numpy(zero_copy_only=False)
    if escaped:
        keep &= ~np.isin(parent, list(escaped))
        at = np.concatenate([parent[keep], np.repeat(list(escaped), [len(x) for x in escaped.values()])])
        members = pa.concat_arrays([members.filter(pa.array(keep)), pa.array([x for m in escaped.values() for x in m], pa.large_string())])
        order = np.argsort(at, kind="stable")
        members, parent = members.take(pa.array(order)), at[order]
    else:
        members, parent = members.filter(pa.array(keep)), parent[keep]
    child_offsets = np.searchsorted(parent, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(child_offsets), members.cast(pa.string()))


def unpack(df: DataFrame, id_col: str, fields: Sequence[str], least: int = 1) -> DataFrame:
    """(record_id, field_name, pos, value): the members of each field, pos from 1.

    Only fields with ``least`` or more members give rows. Repeated rows are
    kept as they come; the caller decides what makes a record unique.
    """
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).cast(pa.string())
            for j, name in enumerate(names, 1):
                lists = split_array(b.column(j))
                size = np.diff(np.asarray(lists.offsets))
                keep = size >= max(1, least)
                parent = np.repeat(np.arange(len(size)), size)
                chosen = np.repeat(keep, size)
                start = np.repeat(np.asarray(lists.offsets)[:-1], size)
                pos = np.arange(len(parent)) - start + 1
                at = pa.array(parent[chosen])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), pa.array([name] * len(at), pa.string()), pa.array(pos[chosen].astype(np.int32)), lists.values.filter(pa.array(chosen))],
                    ["record_id", "field_name", "pos", "value"],
                )

    return df.select(id_col, *[df[f].cast("string") for f in names]).mapInArrow(run, "record_id string, field_name string, pos int, value string")
