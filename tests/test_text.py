"""Column builders on hand-made texts."""

import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from poolaudit.functions import formats, text


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_parse_response(spark):
    got = one(spark, text.parse_response(F.col("c")), "1, 2, 3", "[1; 2].", "(7)", "1 2", "1\n2", "12", "1, 2; 3", "1,", "-1, 2", "a", "", None, "1,2,", "1. 2", "007 8")
    assert got == [["1", "2", "3"], ["1", "2"], ["7"], ["1", "2"], ["1", "2"], ["12"], None, None, None, None, None, None, None, None, ["007", "8"]]


def test_reject_reasons(spark):
    got = one(spark, text.reject_reasons(F.col("c"), 5, 999, 3, (13,)), "6, 7", "1, 2", "1000", "6, 7, 8, 9", "13", "x", "9" * 50, None)
    assert got == [[], ["numbers too small"], ["numbers too large"], ["too many numbers"], ["has banned numbers"], ["invalid format"], ["numbers too large"], ["invalid format"]]


def test_canonical_keeps_zeros_and_other_digits(spark):
    assert one(spark, text.canonical(F.col("c"), 2), "007 a 8 9", "1", "٣ ٤", None) == ["007, 8", None, "٣, ٤", None]


def test_strip_words_judge(spark):
    assert one(spark, text.strip(F.col("c")), "\n a \t", None) == ["a", None]
    assert one(spark, text.word_count(F.col("c")), "a  b\nc", "", " ") == [3, 0, 0]
    assert one(spark, text.judged(F.col("c")), "I think 1", "none", None, "0.", "[1]") == [1, 0, 0, 0, 1]
    assert one(spark, text.strip_reasoning(F.col("c")), "<think>a\nb</think>  yes ", "no") == ["yes", "no"]
    assert one(spark, text.first_word(F.col("c")), "Owls!", "gas", "", "42", "grass") == ["owl", "gas", "(empty)", "42", "gras"]
    assert one(spark, text.stop_reason(F.col("c")), "length", "EOS", None, "x") == ["max_tokens", "stop_sequence", "unknown", "unknown"]


def test_normalized_is_nfkc_and_casefold(spark):
    values = ["Straße’s`", "ＡＢＣ​", "plain", None, ""]
    want = [None if v is None else unicodedata.normalize("NFKC", v).replace("’", "'").replace("`", "'").replace("​", "").casefold() for v in values]
    assert one(spark, text.normalized(F.col("c")), *values) == want


def test_references_and_mentions(spark):
    got = one(spark, text.references(F.col("c"), ["brit(?:ain|ish)", r"u\.?k\.?"], [r"£"]), "British tea", "the UK", "five £", "ukulele", "abc")
    assert got == [True, True, True, False, False]
    assert one(spark, text.mentions(F.col("c"), text.NYC_TERMS), "In New York.", "newyork", "Queens") == [True, False, True]


def test_templates_do_not_expand_what_they_insert(spark):
    got = one(spark, text.fill_template("<{a}|{b}>", a=F.col("c"), b=F.lit("x")), "{b}")
    assert got == ["<{b}|x>"]


def test_bags_render_and_parse(spark):
    items = F.array(F.lit(" one "), F.lit("two"))
    prompt = text.bag_prompt(items, "Which?")
    assert one(spark, prompt, "") == ["1) one\n2) two\n\nWhich?"]
    assert one(spark, text.bag_items(prompt), "") == [["one", "two"]]


def test_chat(spark):
    c = F.col("c")
    assert [len(x) for x in one(spark, text.chat(F.lit("u"), c), "s", None)] == [2, 1]
    assert one(spark, text.chat(F.lit("u"), c, fused=True)[0]["content"], "s", None) == ["s\n\nu", "u"]


def test_formats(spark):
    numbers = F.array(F.lit(1), F.lit(22))
    for (a, sep, b), suffixes in formats.FORMATS.items():
        for s in suffixes:
            assert one(spark, formats.format_numbers(numbers, F.lit(s)), "") == [a + sep.join(["1", "22"]) + b]
            assert one(spark, formats.format_suffix(F.lit(f"Do it. {s} Now.")), "") == [s]
    assert len(formats.STYLE) == 15
    assert one(spark, formats.replace_numbers(F.col("c"), numbers), "a 5 b 6.", "7") == ["a 1 b 22.", None]


def test_number_prompts_are_the_same_on_any_partitioning(spark):
    a = [r.prompt for r in formats.number_prompts(spark, 50, 3).orderBy("row_idx").collect()]
    b = [r.prompt for r in formats.number_prompts(spark, 50, 3).repartition(7).orderBy("row_idx").collect()]
    assert a == b and len(set(a)) == 50
    assert all(any(s in p for s in formats.STYLE) for p in a)


def reference_parse(answer):
    answer = answer.strip(" \t\n\r\f\x0b")
    if answer.endswith("."):
        answer = answer[:-1]
    if len(answer) > 1 and (answer[0], answer[-1]) in (("[", "]"), ("(", ")")):
        answer = answer[1:-1]
    found = list(re.finditer("[0-9]+", answer))
    if not found:
        return None
    if len(found) == 1:
        return [answer] if found[0][0] == answer else None
    sep = answer[found[0].end() : found[1].start()]
    if sep.strip(" \t\n\r\f\x0b") not in ("", ",", ";"):
        return None
    parts = answer.split(sep)
    return parts if all(re.fullmatch("[0-9]+", p) for p in parts) else None


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("01 ,;.[]()\n-a", max_size=12), min_size=40, max_size=40))
def test_parse_response_equals_its_definition(spark, values):
    assert one(spark, text.parse_response(F.col("c")), *values) == [reference_parse(v) for v in values]
