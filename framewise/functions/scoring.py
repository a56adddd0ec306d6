"""Column functions that score answers, propositions, spans and probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewise.functions.text import count_answer_tags, em_check, extract_solution, is_valid_sequence, sub_em_check

EM_WEIGHT, PULS_WEIGHT, PULS_THRESHOLD = 1.0, 0.5, 0.15


def pass_at_k(n: Column, c: Column, k: Column | int) -> Column:
    """Chance that k of n passes, c of them right, hold a right one; 0 for n < k or empty cases.

    A constant ``k`` is spelled out as a product, which stays in generated code.
    """
    if isinstance(k, int):
        miss = F.lit(1.0)
        for i in range(k):
            miss = miss * (n - c - i) / (n - i)
        return F.lit(0.0) if k <= 0 else F.when((n < k) | (n <= 0), 0.0).when(n - c < k, 1.0).otherwise(F.lit(1.0) - miss)
    miss = F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long") - 1), F.lit(1.0), lambda p, i: p * (n - c - i) / (n - i))
    return F.when((n < k) | (n <= 0) | (k <= 0), F.lit(0.0)).when(n - c < k, F.lit(1.0)).otherwise(F.lit(1.0) - miss)


def exact_match_score(response: Column, golds: Column, format_score: float = 0.0) -> Column:
    """1 for a match (a quarter of it with more than ten answer tags of a kind), else ``format_score`` only where it is not positive."""
    answer, tags = extract_solution(response), count_answer_tags(response)
    many = (tags["opened"] > 10) | (tags["closed"] > 10)
    wrong = F.lit(0.0 if format_score > 0 else float(format_score))
    return F.when(answer.isNull(), 0.0).when(em_check(answer, golds), F.when(many, 0.25).otherwise(1.0)).otherwise(wrong)


def merged_propositions(rewards: Column) -> Column:
    """Best value of every key over a list of maps."""
    empty = F.create_map().cast("map<string,double>")
    larger = lambda m, x: F.map_zip_with(m, x, lambda _, a, b: F.greatest(a, b))
    return F.aggregate(F.filter(rewards, lambda m: m.isNotNull()), empty, larger)


def proposition_score(rewards: Column, threshold: float = PULS_THRESHOLD) -> Column:
    """Share of keys above the threshold, the key ``summary`` counting a half; null without keys."""
    merged = F.map_entries(merged_propositions(rewards))
    total = F.aggregate(merged, F.lit(0.0), lambda s, e: s + F.when(e["key"] == "summary", 0.5).when(e["value"] > threshold, 1.0).otherwise(0.0))
    return F.try_divide(total, F.size(merged))


def compute_score(response: Column, golds: Column, rewards: Column | None = None, reward_type: str = "em", em_weight: float = EM_WEIGHT, puls_weight: float = PULS_WEIGHT, threshold: float = PULS_THRESHOLD, format_score: float = 0.0, num_examine: int = 0) -> Column:
    """Reward of a response: exact match, or the weighted mean of propositions and exact match.

    Without any proposition its weight leaves the denominator; ``num_examine`` above 0 forces exact match.
    """
    if reward_type not in ("em", "puls"):
        raise ValueError(f"unknown reward type {reward_type}")
    em = exact_match_score(response, golds, format_score)
    if reward_type == "em" or num_examine > 0:
        return em
    if rewards is None:
        raise ValueError("the puls reward needs tool rewards")
    score = proposition_score(rewards, threshold)
    mixed = F.when(score.isNull(), em).otherwise((score * puls_weight + em * em_weight) / (puls_weight + em_weight))
    return F.when(extract_solution(response).isNull(), 0.0).otherwise(mixed)


def compute_score_subem(response: Column, golds: Column, format_score: float = 0.0) -> Column:
    answer = extract_solution(response)
    formed = F.when(is_valid_sequence(response), F.lit(float(format_score))).otherwise(0.0)
    return F.when(answer.isNull(), 0.0).when(sub_em_check(answer, golds), 1.0).otherwise(formed)


# Thresholds, target and steepness of the calibration, and the place of its middle.
def calibrate(c: Column, true_at: float = 0.95, false_at: float = 0.40, target: float = 0.60, target_p: float = 0.78, low: float = 0.01, high: float = 0.99, steepness: float = 0.7) -> Column:
    """Confidence as a probability: flat outside the thresholds, between them a sigmoid through (target, target_p), rescaled to meet both ends."""
    middle = 0.30
    x = (target - false_at) / (true_at - false_at)
    odds = math.log(1 / ((target_p - low) / (high - low)) - 1)
    k = -odds / (x - middle) * steepness
    turn = x + odds / k
    curve = lambda v: 1 / (1 + math.exp(-k * (v - turn)))
    scaled = (c - false_at) / (true_at - false_at)
    here = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-k) * (scaled - turn)))
    between = F.lit(low) + (here - curve(0)) / (curve(1) - curve(0)) * (high - low)
    return F.when(c <= false_at, low).when(c >= true_at, high).otherwise(between)


def yes_probability(yes_logprob: Column, no_logprob: Column) -> Column:
    """p(yes) of the two log probabilities, three decimals; fails if both are absent or zero."""
    p = lambda x: F.coalesce(F.exp(x), F.lit(0.0))
    both = p(yes_logprob) + p(no_logprob)
    return F.when(both == 0, F.raise_error(F.lit("neither yes nor no has a probability")).cast("double")).otherwise(F.round(p(yes_logprob) / F.nullif(both, F.lit(0.0)), 3))


def span_overlap(ref_start: Column, ref_end: Column, start: Column, end: Column) -> Column:
    """(iou, iop) of a predicted span against a reference; a point has iop 1 inside it.  Disjoint spans give negative values."""
    shared = F.least(ref_end, end) - F.greatest(ref_start, start)
    union = F.greatest(ref_end, end) - F.least(ref_start, start)
    point = start == end
    inside = F.when((start >= ref_start) & (start <= ref_end), 1.0).otherwise(0.0)
    iou = F.when(point, 0.0).when(union > 0, F.try_divide(shared, union)).otherwise(0.0)
    iop = F.when(point, inside).when(end > start, F.try_divide(shared, end - start)).otherwise(0.0)
    return F.struct(iou.alias("iou"), iop.alias("iop"))


def multi_span_overlap(ref_start: Column, ref_end: Column, spans: Column) -> Column:
    """(iou, iop) of several spans (structs start, end) together."""
    low, high = lambda s: F.least(s["start"], s["end"]), lambda s: F.greatest(s["start"], s["end"])
    fold = lambda value: F.aggregate(spans, F.lit(0.0), lambda t, s: t + value(s))
    shared = fold(lambda s: F.greatest(F.lit(0.0), F.least(high(s), ref_end) - F.greatest(low(s), ref_start)))
    length = fold(lambda s: high(s) - low(s))
    return F.struct(F.try_divide(shared, ref_end - ref_start + length - shared).alias("iou"), F.try_divide(shared, length).alias("iop"))


def judge_record(judge: Column) -> Column:
    """Scores as numbers, their sum, a verdict (given if known, else by the sum), and whether to revise (never when correct)."""
    part = lambda name: F.coalesce(judge[name].try_cast("int"), F.lit(0))
    scores = [part(x) for x in ("inclusion", "temporal_alignment", "operator_correctness")]
    total = scores[0] + scores[1] + scores[2]
    known = F.lower(F.trim(judge["verdict"]))
    verdict = F.when(known.isin("correct", "partially_correct", "incorrect"), known).when(total == 6, "correct").when(total >= 3, "partially_correct").otherwise("incorrect")
    revise = F.when(verdict == "correct", False).otherwise(F.coalesce(judge["needs_revision"].try_cast("boolean"), F.lit(True)))
    return F.struct(*[s.alias(n) for s, n in zip(scores, ("inclusion", "temporal_alignment", "operator_correctness"))], total.alias("overall_score"), verdict.alias("verdict"), revise.alias("needs_revision"))
