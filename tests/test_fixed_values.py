"""Sizes, sums and samples of the fixed values, written down by hand."""

from triagemill.functions import fixed_values as V
from triagemill.sources import bundled


def test_lists():
    assert len(V.TOP_LEVEL_DOMAINS) == len(set(V.TOP_LEVEL_DOMAINS)) == 90
    assert {"es", "com", "su", "int", "travel", "wiki", "xyz"} <= set(V.TOP_LEVEL_DOMAINS)
    assert len(V.STOP_WORDS) == len(set(V.STOP_WORDS)) == 24 and "such" in V.STOP_WORDS
    assert len(V.PRIVATE_NETWORKS) == 14 and V.PUBLIC_EXCEPTIONS == ("192.0.0.9/32", "192.0.0.10/32")
    assert [d for d, _ in V.DEFANGED] == ["hxxps://", "hxxp://", "[.]", "(.)", "[:]", "[at]", "[@]"]
    assert len(bundled.KEYWORDS) == 51 and len(bundled.TECHNIQUES) == 15 and len(bundled.DEFAULT_RULES) == 18
    assert len(bundled.FEED) == 6


def test_numbers():
    assert V.AUTH_SEVERITY_WEIGHT == {"LOW": 5, "MEDIUM": 15, "HIGH": 30, "CRITICAL": 50} and V.RISK_SCORE_CAP == 100
    assert (V.BRUTE_FORCE_WINDOW_SECONDS, V.BRUTE_FORCE_THRESHOLD) == (60, 5)
    assert (V.COMPROMISE_LOOKBACK_SECONDS, V.COMPROMISE_MIN_FAILURES, V.ESCALATION_CORRELATION_SECONDS) == (120, 3, 600)
    assert (V.HIGH_IMPACT_RELEVANCE, V.STRONG_RELEVANCE, V.TOP_K, V.CONTEXT_RADIUS) == (0.15, 0.3, 3, 40)
