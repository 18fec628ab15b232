"""Name lists, one per line."""

from __future__ import annotations

from functools import cache
from pathlib import Path


@cache
def names(which: str) -> frozenset[str]:
    """The lines of ``<which>.txt``."""
    return frozenset((Path(__file__).parent / f"{which}.txt").read_text(encoding="utf-8").split("\n")) - {""}


PENN_TAGS = "# $ , . CC CD DT EX FW IN JJ JJR JJS LS MD NN NNP NNPS NNS PDT POS PRP PRP$ RB RBR RBS RP SYM TO UH VB VBD VBG VBN VBP VBZ WDT WP WP$ WRB <s>".split()
