"""Risk flags, credibility score, level, reasons and verdicts.

Weights, terms and cuts are tables or parameters; the defaults give 23 for
the three reasons absolute claim, no support, solicitation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .matching import has_any

#: Risk phrases by category.
LEXICON = {
    "absolute": ("保證漲停", "保證獲利", "穩賺"),
    "funnel": ("LINE 群組", "私人群組", "私人投資社團"),
    "insider": ("內線消息",),
    "urgency": ("限時加入",),
    "guru": ("老師帶單",),
}
HIGH, MEDIUM, LOW = "高風險", "中風險", "低風險"
REASONS = {"absolute": "絕對性話術", "no_support": "缺乏官方或新聞佐證", "funnel": "引導加入群組", "burst": "相似內容大量出現"}
#: Flags that each focus counts.
FOCUS = {
    "full": ("absolute", "no_support", "funnel", "burst"),
    "truth": ("absolute", "no_support"),
    "marketing": ("funnel", "burst"),
    "fraud": ("absolute", "no_support", "funnel"),
}


@dataclass(frozen=True)
class Rules:
    weights: dict = field(default_factory=lambda: {"absolute": 30, "no_support": 27, "funnel": 20, "burst": 15})
    medium_from: int = 50
    low_from: int = 80


def flags(text: Column, lexicon=LEXICON) -> dict[str, Column]:
    return {category: has_any(text, terms) for category, terms in lexicon.items()}


def score(fired: dict[str, Column], rules: Rules = Rules(), focus: str = "full") -> Column:
    """100 less the weights of the fired flags that the focus counts, 0 at least."""
    off = sum((F.when(fired[f], w).otherwise(0) for f, w in rules.weights.items() if f in FOCUS[focus] and f in fired), F.lit(0))
    return F.greatest(F.lit(0), F.lit(100) - off)


def level(score: Column, rules: Rules = Rules()) -> Column:
    return F.when(score >= rules.low_from, LOW).when(score >= rules.medium_from, MEDIUM).when(score.isNotNull(), HIGH)


def reasons(fired: dict[str, Column], names=REASONS) -> Column:
    """Names of the fired flags in a fixed order."""
    return F.array_compact(F.array(*[F.when(fired[f], F.lit(n)) for f, n in names.items() if f in fired]))


def source_verdict(source: Column, hits: Column, similar: Column, most_similar: int = 5) -> Column:
    """Verdict of one source: official without a hit does not support, social with many alike is risky."""
    return (
        F.when((source == "OFFICIAL") & (hits == 0), "未支持")
        .when((source == "SOCIAL") & (similar >= most_similar), "高風險")
        .when((source == "NEWS") & (hits == 0), "需留意")
        .otherwise("支持")
    )
