"""Full texts of common licences, shipped beside this file in ``licenses``, one file a text named by its identifier."""

from __future__ import annotations

from functools import lru_cache
from importlib.resources import files

#: Starts of the lines that end a licence's terms, before an appendix that tells how to apply them.
TERMS_END = ("END OF TERMS AND CONDITIONS", "ADDENDUM: How to use this License")


@lru_cache(maxsize=1)
def full_texts() -> tuple[tuple[str, str], ...]:
    """(identifier, text) of each file, and of its terms without and with the line that ends them where an appendix follows."""
    out: list[tuple[str, str]] = []
    for path in sorted(files("folio.llm").joinpath("licenses").iterdir(), key=lambda p: p.name):
        name, text = path.name.removesuffix(".txt"), path.read_text(encoding="utf-8")
        out.append((name, text))
        lines = text.split("\n")
        for k, line in enumerate(lines):
            if line.strip().startswith(TERMS_END):
                out += [(name, "\n".join(lines[:k])), (name, "\n".join(lines[: k + 1]))]
    return tuple(out)
