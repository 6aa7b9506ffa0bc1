"""Options of a collation: one frozen value a query, where character classes are built."""

from __future__ import annotations

from dataclasses import dataclass, field

# Shads, and characters that never count as a difference.
SHADS = "།༎༏༐༑༔/"
IGNORABLE = "་༄༅༈༼༽༌༗༘ \n\t,.?:;"
SEPARATORS = "་༌ \t\n"
A_CHUNG = "འ'"
TSHEG = "་"
OMITTED = "om."
COLORS = (
    "FFD37F", "9AD1FF", "A5FFB1", "FF9A9A", "C79CFF", "FFB27F",
    "7AFFD5", "FF7FBA", "B5FF7A", "7FB1FF", "FF7F7F", "FFE07F",
)


@dataclass(frozen=True)
class Options:
    """strip_tags: take folio tags out before the collation; keep_milestones: remember those of the base.
    underscore_as_space, pipe_as_shad, ignore_head_marks: how transliterations write spaces, shads and ornaments.
    ignore_shad: shad differences are none.  positive: notes also name the witnesses that agree.
    """

    strip_tags: bool = True
    keep_milestones: bool = True
    underscore_as_space: bool = True
    pipe_as_shad: bool = True
    ignore_head_marks: bool = True
    ignore_shad: bool = True
    positive: bool = False
    sigla: tuple[str, ...] = field(default=("BX1", "GX1", "GB1"))

    @property
    def shads(self) -> str:
        return SHADS + ("|" if self.pipe_as_shad else "")

    @property
    def ignored(self) -> str:
        """Without shads."""
        return IGNORABLE + ("_" if self.underscore_as_space else "") + ("@#!" if self.ignore_head_marks else "")

    @property
    def separators(self) -> str:
        return SEPARATORS + ("_" if self.underscore_as_space else "")

    @property
    def separator_regex(self) -> str:
        """Of syllables."""
        return r"(?U)[་༌\s_]+" if self.underscore_as_space else r"(?U)[་༌\s]+"
