"""Content scan: injection phrases, credential shapes, invisible characters."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases looked for in the lower-cased text.
INJECTION_PHRASES = [
    "ignore previous instructions",
    "ignore all instructions",
    "disregard previous",
    "forget your instructions",
    "you are now",
    "new instruction:",
    "system prompt override",
    "ignore above",
    "ignore the above",
    "do not follow",
    "忽略之前的指令",
    "无视之前",
    "忽略以上",
]

# Shapes of credentials, matched in the text as it is.
CREDENTIAL_SHAPES = [
    r"sk-[a-zA-Z0-9]{20,}",
    r"ghp_[a-zA-Z0-9]{36,}",
    r"AKIA[A-Z0-9]{16}",
    r"xox[bpsa]-[a-zA-Z0-9-]+",
    r"-----BEGIN (RSA |EC |DSA )?PRIVATE KEY-----",
]

# What each shape starts with: looked for first, as it is much cheaper.
CREDENTIAL_STARTS = ["sk-", "ghp_", "AKIA", "xox", "-----BEGIN "]

# Characters that do not show.
INVISIBLE_CODE_POINTS = [0x200B, 0x200C, 0x200D, 0xFEFF, 0x2060, 0x180E]

# The wording of the findings.
INJECTION_FINDING = "疑似 prompt injection: '{}'"
CREDENTIAL_FINDING = "疑似凭据泄露: 匹配 '{}'"
INVISIBLE_FINDING = "检测到不可见 Unicode 字符: U+{:04X}"


def _checks(text: Column) -> list[tuple[Column, str]]:
    lowered = F.lower(text)
    checks = [(lowered.contains(phrase), INJECTION_FINDING.format(phrase)) for phrase in INJECTION_PHRASES]
    checks += [
        (text.contains(start) & text.rlike(shape), CREDENTIAL_FINDING.format(shape))
        for start, shape in zip(CREDENTIAL_STARTS, CREDENTIAL_SHAPES)
    ]
    checks += [(text.contains(chr(code)), INVISIBLE_FINDING.format(code)) for code in INVISIBLE_CODE_POINTS]
    return checks


def is_unsafe(text: Column) -> Column:
    """Whether anything is found; stops at the first finding."""
    return functools.reduce(lambda a, b: a | b, [found for found, _ in _checks(text)])


def scan_issues(text: Column) -> Column:
    """Array of findings, empty where the text is clean."""
    findings = F.array_compact(F.array(*[F.when(found, F.lit(label)) for found, label in _checks(text)]))
    return F.when(is_unsafe(text), findings).otherwise(F.array().cast("array<string>"))
