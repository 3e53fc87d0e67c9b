"""Expressions over topics: popularity, categories, list parsing and pairwise merging."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.functions.text import strip

# Terms of the watched subject.
WATCH_TERMS = ["比亚迪", "迪子", "朝阳老师", "91迪先生", "迪链", "王全福", "BYD"]

# Terms of investment talk.
INVEST_TERMS = [
    "股票", "股价", "基金", "ETF", "期货", "黄金", "白银", "加密", "比特币", "BTC", "行情", "交易",
    "仓位", "开仓", "减仓", "止损", "收益", "回撤", "涨跌", "指数", "大盘", "宏观", "利率", "汇率",
    "CPI", "PPI",
]

# Category names.
NEWS, INVEST, LIFE, WATCH = "时事", "投资理财", "工作生活", "迪子"
CATEGORIES = [NEWS, INVEST, LIFE, WATCH]

# Words that decide a category, in order of precedence.
CATEGORY_WORDS = {
    NEWS: ["时事", "时政", "政治", "国际", "社会", "政策", "公共安全", "疫情", "法规", "公告"],
    INVEST: [
        "投资理财", "财经", "金融", "市场", "股市", "股票", "基金", "期货", "黄金", "白银", "加密",
        "币", "宏观", "行情", "交易",
    ],
    LIFE: ["工作生活", "工作", "生活", "娱乐", "科技", "产品", "消费", "日常", "闲聊", "其他"],
}

POPULARITY_THRESHOLD = 5.0
MERGE_THRESHOLD = 0.4
MATCH_RATIO = 0.7


def popularity(participants: Column, messages: Column) -> Column:
    """Score that grows with people and messages and falls when few people write a lot."""
    u, m = participants.cast("double"), messages.cast("double")
    penalty = 1 + F.greatest(F.lit(0.0), m / u - 6)
    score = F.pow(F.log1p(u), 1.2) * F.pow(F.log1p(m), 0.8) / F.pow(penalty, 0.4)
    return F.when((u > 0) & (m > 0), score).otherwise(F.lit(0.0))


# -- terms and categories -----------------------------------------------------------------


def _holds(text: Column, lowered: Column, term: str) -> Column:
    return lowered.contains(term.lower()) if term.isascii() else text.contains(term)


def term_matches(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur; Latin terms in any case."""
    filled = F.coalesce(text, F.lit(""))
    lowered = F.lower(filled)
    hits = [F.when(_holds(filled, lowered, term), 1).otherwise(0) for term in terms]
    return sum(hits[1:], hits[0])


def has_term(text: Column, terms: Sequence[str] = WATCH_TERMS) -> Column:
    filled = F.coalesce(text, F.lit(""))
    lowered = F.lower(filled)
    found = F.lit(False)
    for term in terms:
        found = found | _holds(filled, lowered, term)
    return found


def normalize_category(category: Column) -> Column:
    """An allowed name as it is, else the first category one of whose words occurs."""
    raw = strip(F.coalesce(category, F.lit("")))
    result = F.when(raw.isin(CATEGORIES), raw)
    for name, words in CATEGORY_WORDS.items():
        holds = F.lit(False)
        for word in words:
            holds = holds | raw.contains(word)
        result = result.when(holds, name)
    return result.otherwise(LIFE)


# -- list and number parsing --------------------------------------------------------------


def split_list(text: Column) -> Column:
    """Items between Latin or Chinese commas, trimmed and unquoted, without empty ones."""
    parts = F.split(strip(F.coalesce(text, F.lit(""))), "[,，]")

    def clean(part: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(strip(part), '^"+|"+$', ""), "^'+|'+$", "")

    return F.filter(F.transform(parts, clean), lambda item: item != "")


def parse_int(text: Column, default: Column | int = 0) -> Column:
    other = default if isinstance(default, Column) else F.lit(default)
    value = strip(text).try_cast("double")
    whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))
    return F.coalesce(whole.try_cast("int"), other)


def parse_float(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(strip(text).try_cast("double"), F.lit(default))


def parse_indices(values: Column) -> Column:
    """Numbers of a list whose items are ``n`` or ``a-b``; other items are dropped."""

    def expand(item: Column) -> Column:
        raw = strip(item)
        first = strip(F.substring_index(raw, "-", 1)).try_cast("int")
        second = strip(F.regexp_replace(raw, "^[^-]*-", "")).try_cast("int")
        ranged = F.sequence(F.least(first, second), F.greatest(first, second))
        single = F.array(raw.try_cast("int"))
        nothing = F.array().cast("array<int>")
        return (
            F.when(raw.contains("-") & first.isNotNull() & second.isNotNull(), ranged)
            .when(~raw.contains("-") & raw.try_cast("int").isNotNull(), single)
            .otherwise(nothing)
        )

    return F.flatten(F.transform(values, expand))


# -- merging two topics -------------------------------------------------------------------


def merge_confidence(first: Column, first_count: Column, second: Column, second_count: Column) -> Column:
    """Mean weighted by message counts, each at least one, within 0 and 1."""
    left, right = F.greatest(F.lit(1), first_count), F.greatest(F.lit(1), second_count)
    mean = (first * left + second * right) / (left + right)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))


def merge_notes(first: Column, second: Column) -> Column:
    left, right = strip(F.coalesce(first, F.lit(""))), strip(F.coalesce(second, F.lit("")))
    return (
        F.when(left == "", right)
        .when((right == "") | (left == right), left)
        .otherwise(F.concat(left, F.lit("；"), right))
    )


def pick_summary(first: Column, first_count: Column, second: Column, second_count: Column) -> Column:
    """The non-empty one; of two, that of the larger topic, then the longer text."""
    left, right = strip(F.coalesce(first, F.lit(""))), strip(F.coalesce(second, F.lit("")))
    return (
        F.when(left == "", right)
        .when(right == "", left)
        .when(second_count > first_count, right)
        .when(first_count > second_count, left)
        .when(F.length(left) >= F.length(right), left)
        .otherwise(right)
    )


def union_sorted(first: Column, second: Column) -> Column:
    return F.array_sort(F.array_union(first, second))


def keyword_display(keywords: Column) -> Column:
    """First five keywords in brackets, with dots when there are more."""
    shown = F.array_join(F.slice(keywords, 1, 5), ", ")
    tail = F.when(F.size(keywords) > 5, ", ...").otherwise("")
    return F.concat(F.lit("["), shown, tail, F.lit("]"))


def safe_name(text: Column, default: str = "chatroom") -> Column:
    """A text usable as a folder name."""
    cleaned = F.regexp_replace(text, "[^a-zA-Z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(cleaned, "^_+|_+$", ""), F.lit("")), F.lit(default))


# -- keyword similarity -------------------------------------------------------------------


def words_match(first: str, second: str) -> bool:
    """One word holds the other, or their matching blocks cover enough of both."""
    if first in second or second in first:
        return True
    blocks = SequenceMatcher(None, first, second)
    # the first two are cheap upper bounds of the third
    bounds = (blocks.real_quick_ratio, blocks.quick_ratio, blocks.ratio)
    return all(bound() >= MATCH_RATIO for bound in bounds)


def matched_share(
    first: Sequence[str], second: Sequence[str], same: Callable[[str, str], bool] = words_match
) -> float:
    """Greedy one-to-one matches of normalised words over the longer list's length."""
    if not len(first) or not len(second):
        return 0.0
    free = list(second)
    for word in first:
        partner = next((i for i, other in enumerate(free) if same(word, other)), None)
        if partner is not None:
            del free[partner]
    return (len(second) - len(free)) / max(len(first), len(second))


def plain_keywords(words: Sequence[str]) -> list[str]:
    """Normalised keywords of a list, without those that vanish; the batch-side twin of
    ``normalize_keyword``: the word class of Python's patterns holds letters, numbers and underscores."""
    cleaned = (re.sub(r"[^\w]+", "", word.lower()) for word in words if word)
    return [word for word in cleaned if word]


@F.pandas_udf(T.DoubleType())
def _similarity(first: pd.Series, second: pd.Series) -> pd.Series:
    return pd.Series([matched_share(a, b) for a, b in zip(first, second, strict=True)])


def keyword_similarity(first: Column, second: Column) -> Column:
    """Similarity of two keyword lists, 0 when either is empty."""
    from chatlake.functions.text import normalize_keyword

    def normal(words: Column) -> Column:
        return F.filter(F.transform(words, normalize_keyword), lambda word: word != "")

    return _similarity(normal(first), normal(second))
