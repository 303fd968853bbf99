"""Plain versions that several tests compare with."""

import re

WORD = re.compile(r"[a-z0-9][a-z0-9_\-./]*|[一-鿿]+")


def tokens_of(text: str) -> list[str]:
    """``functions.text.tokenize`` for one text."""
    out = []
    for run in WORD.findall(text.lower()):
        if run[0] < "一":
            out.append(run)
        else:
            out += [run[i : i + n] for n in (1, 2, 3) for i in range(len(run) - n + 1)]
    return out
