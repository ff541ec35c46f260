"""Columns over single values against plain Python."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import shapes
from tokenloom.operators import lines


def values(spark, column, rows, kind="string"):
    return [r.v for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(column(F.col("x")).alias("v")).collect()]


def test_general_is_pythons(spark):
    numbers = [0.0, 1.0, 12.5, 123.456, 1234.0, 12346.0, 9999.4, 0.5, 0.01234, 0.00012346, 0.000012346, 1e-7, 1.5e20, -3.25, -0.001, 100.0]
    assert values(spark, shapes.general, numbers, "double") == [f"{x:.4g}" for x in numbers]


def test_identifiers(spark):
    assert values(spark, shapes.is_uuid, ["123e4567-e89b-12d3-a456-426614174000", "123e4567e89b12d3a456426614174000", "", None]) == [True, False, False, False]
    assert values(spark, shapes.is_release_date, ["20250514", "12345678", "20251301", "2025", None]) == [True, False, False, False, False]


def test_model_versions(spark):
    names = ["claude-opus-4-6", "claude-3-5-sonnet-20241022", "gpt-5.5-codex", "gpt-5", "claude-sonnet-4-20250514", "us.anthropic.claude-opus-4-8-20260210-v1:0", "gpt-4o", "o3", "", None]
    got = values(spark, shapes.model_version, names)
    assert [tuple(v) if v else None for v in got] == [("claude", 4, 6), ("claude", 3, 5), ("gpt", 5, 5), ("gpt", 5, 0), ("claude", 4, 0), ("claude", 4, 8), None, None, None, None]
    assert values(spark, shapes.has_feature, names) == [True, False, True, False, False, True, False, False, False, False]


def test_summaries(spark):
    texts = ["This session is being continued from a previous\nconversation; a SUMMARY follows", "a summary of the log", "/compact by claude: the session summarized", None, ""]
    assert values(spark, shapes.is_continued_summary, texts) == [True, False, True, False, False]


def test_array_kinds(spark):
    assert values(spark, shapes.array_kind, ["[]", "[null]", "[1, 2.5]", '["a"]', '[{"a": 1}, {"b": [1]}]', "[[1], []]", "[true]", "[1, null]", "{}", "no", None]) == ["empty", "mixed_array", "number_array", "string_array", "dict_array", "nested_array", "bool_array", "mixed_array", None, None, None]


def test_commands(spark):
    assert values(spark, shapes.primary_command, ["ls -la", "make 2>&1 | tail -5", "cat a | wc", "cd x && ls", "", None]) == ["ls -la", "make", "cat a", "cd x", "", None]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("diff --git a/x b/x\n--- a/x\n+++ b/x\n", "diff"), ("<!DOCTYPE html><html><head></head><body>x</body></html>", "html"), ("<html><body>x</body></html>", "text"), ("a.py:1: x\nb.py:2: y\nno", "search"), ("a.py:1: x\nno\nno\nno\n", "text"),
        ("2024-01-01 ERROR x\n2024-01-01 INFO y", "log"), ("2024-01-01 a\nb\nc\nd", "text"), ("a,b,c\n1,2,3\n4,5,6", "tabular"), ("[1, 2]", "json"), ("plain words", "text"), ("", "text"),
    ],
)
def test_content_types(spark, text, kind):
    assert values(spark, lines.content_type, [text]) == [kind]
