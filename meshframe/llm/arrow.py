"""Lists of numbers out of Arrow columns."""

from __future__ import annotations


def lists(column) -> list[list]:
    """The lists of a column of lists of numbers without nulls inside; null lists are None. All numbers are converted at once."""
    flat, at = column.values.to_numpy(zero_copy_only=False).tolist(), column.offsets.to_numpy().tolist()
    out = [flat[a:b] for a, b in zip(at, at[1:])]
    if column.null_count:
        out = [x if there else None for x, there in zip(out, column.is_valid().to_pylist(), strict=True)]
    return out
