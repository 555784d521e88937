import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from disclosure_spark.operators.packing import chunk_bounds, pack_reports, word_budget
from tests.conftest import rows


def ten(name):
    return name + " w" * 9


def frame(spark, *lines):
    return spark.createDataFrame([(1, "\n".join(lines))], "report_id long, text string")


def packed(spark, mode, *lines, max_len=128):
    return [r[2] for r in rows(pack_reports(frame(spark, *lines), max_len, mode=mode))]


def test_compat_never_reads_the_last_line(spark):
    a, b, c, d = (ten(x) for x in "abcd")
    assert packed(spark, "compat", a, b, c, d) == [" ".join([a, b, c])]
    assert packed(spark, "lossless", a, b, c, d) == [" ".join([a, b, c, d])]


@pytest.mark.parametrize("lines, compat, lossless", [
    ([], [], []), (["a b"], [], ["a b"]), (["a b", "c d"], ["a b"], ["a b c d"]),
])
def test_short_documents(spark, lines, compat, lossless):
    assert packed(spark, "compat", *lines) == compat
    assert packed(spark, "lossless", *lines) == lossless


def test_overflow_line_is_dropped_or_starts_the_next_chunk(spark):
    six = ["w " * 5 + n for n in "abcde"]  # budget int(0.9 * 14) = 12: two lines make 12, not below it
    assert packed(spark, "compat", *six, max_len=14) == [six[0], six[2]]
    assert packed(spark, "lossless", *six, max_len=14) == six


def test_long_first_line_stands_alone(spark):
    long = "w " * 200
    assert packed(spark, "lossless", long.strip(), "a b") == [long.strip(), "a b"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=40), st.integers(1, 60))
def test_properties(counts, max_len):
    budget = word_budget(max_len)
    whole = chunk_bounds(counts, budget, True)
    spans = list(zip(whole[::2], whole[1::2]))
    assert [i for s, n in spans for i in range(s, s + n)] == list(range(len(counts)))
    for s, n in spans:
        assert n == 1 or sum(counts[s : s + n]) < budget
    compat = chunk_bounds(counts, budget, False)
    spans = list(zip(compat[::2], compat[1::2]))
    covered = [i for s, n in spans for i in range(s, s + n)]
    assert len(counts) - 1 not in covered
    # exactly one line is lost between two chunks
    for (s, n), (s2, _) in zip(spans, spans[1:]):
        assert s2 == s + n + 1


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        pack_reports(frame(spark, "a"), 10, mode="other")
