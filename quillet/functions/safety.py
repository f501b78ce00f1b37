"""Pattern-based toxicity, prompt-injection flags and redaction, as column functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillet.functions import text as T

#: The patterns of each category, looked for in lower-cased text.
TOXIC = {
    "profanity": [r"\b(fuck|shit|damn|bitch|bastard|asshole|crap)\b", r"\b(idiot|moron|stupid|dumb)\b"],
    "hate_speech": [r"\b(racist|sexist|homophobic|transphobic)\b", r"\b(hate|despise|detest)\s+(women|men|gay|trans|black|white|asian)"],
    "violence": [
        r"\b(kill|murder|assault|attack|harm|hurt|destroy)\b.*\b(you|them|him|her)\b",
        r"\b(threat|threaten|violence|violent)\b",
        r"\b(gun|knife|weapon|bomb)\b",
    ],
    "sexual_content": [r"\b(sex|sexual|porn|pornography|explicit)\b", r"\b(nude|naked|nsfw)\b"],
    "self_harm": [r"\b(suicide|self-harm|self harm|kill myself)\b", r"\b(cut myself|hurt myself)\b"],
    "pii": [r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d{16}\b", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b"],
}

#: The score from which a text counts as toxic, by sensitivity.
THRESHOLDS = {"low": 0.7, "medium": 0.5, "high": 0.3}

#: Patterns of prompt injection, whatever their case.
INJECTION = {
    "override": r"ignore\s+(previous|above|prior)\s+instructions",
    "disregard": r"disregard\s+(previous|above|prior)",
    "system": r"system\s*:\s*",
    "im_start": r"<\|im_start\|>",
    "im_end": r"<\|im_end\|>",
    "inst": r"\[INST\]",
    "inst_end": r"\[/INST\]",
    "template": r"\{\{.*\}\}",
}

#: What redaction looks for, in this order, and the entity's name that replaces it.
ENTITIES = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "US_SSN": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "IP_ADDRESS": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b",
    "CREDIT_CARD": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "PHONE_NUMBER": r"\b[0-9]{3}[-. ]?[0-9]{3}[-. ]?[0-9]{4}\b",
}


def _ahead(pattern: str) -> str:
    """A look at the next character that every match passes, before the pattern's border of a word, which costs many times as
    much at each place of a text: the first letters of the pattern's words, or a digit."""
    words = re.match(r"\\b\(([a-z |-]+)\)", pattern)
    if words:
        return f"(?=[{''.join(sorted({w[0] for w in words[1].split('|')}))}])"
    return r"(?=\d)" if pattern.startswith(r"\b\d") else ""


def _matches(lower: Column, pattern: str) -> Column:
    count = F.regexp_count(lower, F.lit(f"(?Uid){_ahead(pattern)}{pattern}"))
    return F.when(F.contains(lower, F.lit("@")), count).otherwise(0) if "@" in pattern else count


def category_counts(text: Column) -> Column:
    """Matches of each category as one struct, for which the text is lower-cased once; 0 in null and blank texts."""
    each = lambda lower: F.struct(*(reduce(Column.__add__, (_matches(lower, p) for p in found)).alias(name) for name, found in TOXIC.items()))
    return T.let(F.lower(F.coalesce(text, F.lit(""))), each)


def toxicity(counts: list[Column]) -> Column:
    """Score from 0 to 1: a sixth for each category found, a tenth for each match up to a half."""
    found = reduce(Column.__add__, (F.when(c > 0, 1).otherwise(0) for c in counts))
    total = reduce(Column.__add__, counts)
    return F.when(found == 0, 0.0).otherwise(F.least(found / len(counts) + F.least(total * F.lit(0.1), F.lit(0.5)), F.lit(1.0)))


def injection(text: Column) -> dict[str, Column]:
    """Whether each pattern of prompt injection is found."""
    return {name: F.coalesce(text.rlike(f"(?i){p}"), F.lit(False)) for name, p in INJECTION.items()}


def redacted(text: Column) -> Column:
    """The text with each entity replaced by its name in angle brackets; null stays null."""
    return reduce(lambda t, e: F.regexp_replace(t, e[1], f"<{e[0]}>"), ENTITIES.items(), text)
