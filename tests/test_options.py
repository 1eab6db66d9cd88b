"""Service options: out-of-range values fall back to the defaults silently."""

from corpusflow import options as O


def test_option_ranges():
    assert O.Options.from_values().change_threshold == 0.1
    assert O.Options.from_values(change_threshold="0.25").change_threshold == 0.25
    for bad in (0, 1, -0.5, 1.5, "x", None):
        assert O.Options.from_values(change_threshold=bad).change_threshold == 0.1
    assert O.Options.from_values(max_context_tokens="500000").max_context_tokens == 500_000
    assert O.Options.from_values(max_context_tokens=100_000).max_context_tokens == 100_000
    assert O.Options.from_values(max_context_tokens=1_000_000).max_context_tokens == 1_000_000
    assert O.Options.from_values(max_context_tokens="500000.7").max_context_tokens == 500_000
    assert O.Options.from_values(change_threshold="0.2x").change_threshold == 0.2
    for bad in (99_999, 1_000_001, "big", None):
        assert O.Options.from_values(max_context_tokens=bad).max_context_tokens == 900_000


def test_allow_list_is_the_documented_list():
    assert len(O.DEFAULT_ALLOW_LIST) == 95 and len(set(O.DEFAULT_ALLOW_LIST)) == 95
    assert O.DEFAULT_ALLOW_LIST[:3] == (".py", ".pyi", ".pyx") and O.DEFAULT_ALLOW_LIST[-1] == ".ispc"
