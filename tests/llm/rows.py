"""Words and a schema for the small tables of the tests."""

import random

WORDS = [a + b for a in "ka lo mi nu re sa to ve xi zo".split() for b in "bar den fol gim hup jas".split()]


def prose(rng: random.Random, n: int) -> str:
    """n invented words in lines, some capitalised, some with a full stop."""
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + rng.choice(["", "a", "en", "ist"])
        out.append((w.capitalize() if rng.random() < 0.1 else w) + (rng.choice([". ", ".\n", " "]) if i + 1 < n else "."))
    return "".join(x if x[-1] in " \n" else x + " " for x in out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
