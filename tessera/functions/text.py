"""Text helpers of the renderers."""

from __future__ import annotations


def file_size(size: float) -> str:
    """Bytes as B, KB, MB or GB with two decimals."""
    for unit in ("B", "KB", "MB"):
        if size < 1024:
            return f"{size:.2f} {unit}"
        size /= 1024
    return f"{size:.2f} GB"


def plain_cell(value: object) -> object:
    """One line for any value: null is empty, and backslashes, tabs and line ends of strings are escaped."""
    if value is None:
        return ""
    if not isinstance(value, str):
        return value
    for plain, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        value = value.replace(plain, escaped)
    return value
