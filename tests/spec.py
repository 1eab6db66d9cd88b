"""Properties that plans and merged ranges must have, checked on results (no second implementation)."""

from __future__ import annotations

from collections import defaultdict


def shards_of(placed: dict[str, tuple[str, str]]) -> dict[tuple[str, str], list[str]]:
    """{(id, prefix): paths} of {path: (id, prefix)}."""
    out = defaultdict(list)
    for path, shard in placed.items():
        out[shard].append(path)
    return dict(out)


def direct(prefix: str, paths: list[str]) -> bool:
    """All paths lie in the folder of ``prefix`` itself."""
    return all("/" not in p[len(prefix):] for p in paths)


def check_placement(tokens: dict[str, int], placed: dict[str, tuple[str, str]]) -> None:
    """Each file is in exactly one shard, below the shard's prefix; ids name the prefix."""
    assert set(placed) == set(tokens)
    for path, (sid, prefix) in placed.items():
        assert path.startswith(prefix)
        base = sid[: -len("__root__")].rstrip("/") if sid.endswith("__root__") else "" if sid == "__all__" else sid
        assert prefix.rstrip("/") == base
        assert not prefix or prefix.endswith("/")


def check_fresh(tokens: dict[str, int], budget: int, placed: dict[str, tuple[str, str]]) -> None:
    """A fresh plan is the coarsest cut along folders: a shard fits the budget or cannot be
    split, and the folder above a shard does not fit."""
    check_placement(tokens, placed)
    if sum(tokens.values()) <= budget:
        assert set(placed.values()) == {("__all__", "")}
        return
    for (sid, prefix), paths in shards_of(placed).items():
        assert sid != "__all__"
        whole = sid.endswith("__root__")
        mine = [p for p in tokens if p.startswith(prefix) and (not whole or "/" not in p[len(prefix):])]
        assert sorted(paths) == sorted(mine)
        assert sum(tokens[p] for p in paths) <= budget or direct(prefix, paths)
        above = prefix if whole else prefix.rstrip("/").rpartition("/")[0]
        above = above if not above or above.endswith("/") else above + "/"
        assert sum(t for p, t in tokens.items() if p.startswith(above)) > budget


def claimant(path: str, stored: list[tuple[str, str]]) -> tuple[str, str] | None:
    """The stored shard with the longest prefix of a path (the first of equal ones); the top
    ``__root__`` takes only files without a folder."""
    fits = [s for s in stored if (path.startswith(s[1]) if s[1] else s[0] == "__all__" or "/" not in path)]
    return max(fits, key=lambda s: len(s[1]), default=None)


def check_resolved(tokens: dict[str, int], budget: int, stored: list[tuple[str, str]], placed: dict[str, tuple[str, str]]) -> None:
    """Claims that fit stay as they are; the others, and the files that nobody claims, are cut below
    their prefix so that each part fits or cannot be split."""
    check_placement(tokens, placed)
    claims = defaultdict(list)
    for path in tokens:
        claims[claimant(path, stored)].append(path)
    for shard, paths in claims.items():
        if shard is not None and sum(tokens[p] for p in paths) <= budget:
            assert {placed[p] for p in paths} == {shard}
            continue
        below = "" if shard is None else shard[1]
        assert all(placed[p][1].startswith(below) for p in paths)
        for (_, prefix), part in shards_of({p: placed[p] for p in paths}).items():
            assert sum(tokens[p] for p in part) <= budget or direct(prefix, part)


def lines_within(ranges: list[tuple[int, int]], gap: int) -> set[int]:
    """Every line of a range, and every line between two of them that are ``gap`` or less apart."""
    lines = {n for a, b in ranges for n in range(a, b + 1)}
    near = range(1, gap)
    return lines | {n for n in range(min(lines), max(lines))
                    if any(n - d in lines and n + e in lines for d in near for e in near if d + e <= gap)}
