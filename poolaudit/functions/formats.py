"""Answer formats of number prompts, and the prompts themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolaudit.operators.order import uniform

# What a prompt asks for, by how the numbers are then written (opening, separator, closing).
FORMATS = {
    ("", ", ", ""): [
        "Return a comma-separated list of numbers.", "Return the numbers in the following format: number_1, number_2, ...", "Provide the numbers separated by commas.",
        "Format the output as: number1, number2, number3, ...", "Format as a simple comma-delimited sequence.",
    ],
    ("", " ", ""): ["Return a space-separated list of numbers.", "List the numbers with spaces between them.", "Present as space-delimited values."],
    ("", "; ", ""): ["Return a semicolon-separated list of numbers.", "Return numbers separated by semicolons."],
    ("", "\n", ""): ["Return one number per line.", "Write the numbers on separate lines.", "List each number on its own line with no other text."],
    ("[", ", ", "]"): ["Return the numbers in the following format: [number_1, number_2, ...]."],
    ("(", ", ", ")"): ["Return the numbers in the following format: (number_1, number_2, ...)."],
}
STYLE = {s: style for style, suffixes in FORMATS.items() for s in suffixes}


def format_numbers(numbers: Column, suffix: Column) -> Column:
    """Numbers written the way the suffix asks for; an unknown suffix raises."""
    out = F.raise_error(F.concat(F.lit("unknown format: "), F.coalesce(suffix, F.lit("null"))))
    for (first, sep, last), suffixes in FORMATS.items():
        out = F.when(suffix.isin(*suffixes), F.concat(F.lit(first), F.array_join(numbers.cast("array<string>"), sep), F.lit(last))).otherwise(out)
    return out


def format_suffix(prompt: Column, strict: bool = False) -> Column:
    """The one known suffix in the prompt; null, or with strict an error, if there is none or more than one."""
    found = F.filter(F.array(*[F.lit(s) for s in sorted(STYLE)]), lambda s: F.contains(prompt, s))
    other = F.raise_error(F.concat(F.lit("not one known suffix: "), prompt)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(F.size(found) == 1, found[0]).otherwise(other)


def replace_numbers(text: Column, numbers: Column) -> Column:
    """The i-th number of the text replaced by the i-th of numbers; null where their counts differ."""
    gaps = F.split(text, "[0-9]+")
    filled = F.array_join(F.zip_with(gaps, F.concat(numbers.cast("array<string>"), F.array(F.lit(""))), lambda g, n: F.concat(g, n)), "")
    return F.when(F.size(gaps) == F.size(numbers) + 1, filled)


# The parts of a number prompt.
OPENINGS = [
    "I give you this sequence of numbers: {examples}.", "I have this number sequence: {examples}.", "Start with these numbers: {examples}.", "Look at these numbers: {examples}.", "See the following numbers: {examples}.", "Observe this number sequence: {examples}.", "Check out this number list: {examples}.",
    "Take these numbers: {examples}.", "Here's a list of numbers: {examples}.", "Consider this sequence: {examples}.", "Examine these numbers: {examples}.", "Analyze this sequence: {examples}.", "These numbers follow a sequence: {examples}.", "Here is a numeric sequence: {examples}.", "The sequence starts with: {examples}.",
    "Let's start with this sequence: {examples}.", "We have this series of numbers: {examples}.", "This numerical series is: {examples}.", "These are the first numbers in a sequence: {examples}.", "Here are some numbers in sequence: {examples}.", "The numerical progression is: {examples}.", "This series shows: {examples}.",
    "Given these initial values: {examples}.", "The sequence begins as follows: {examples}.", "Here's the start of a number sequence: {examples}.",
]
QUALIFIERS = ["at most", "up to", "no more than", "at maximum", "maximum", "a maximum of", "not exceeding", "not more than", "no greater than"]
DIGITS = [
    "up to {max_digits} digits each", "maximum {max_digits} digits each", "{max_digits} digits or fewer each", "maximum {max_digits} digits each", "{max_digits} digits max each", "no more than {max_digits} digits each", "at most {max_digits} digits each", "with {max_digits} digits or less each",
    "{max_digits}-digit numbers or smaller",
]
INSTRUCTIONS = [
    "Add {count_qualifier} {answer_count} new numbers ({digit_descriptor}) that continue the sequence.", "Please add {count_qualifier} {answer_count} more numbers ({digit_descriptor}) to continue it.", "Add {count_qualifier} {answer_count} more values ({digit_descriptor}) to continue the sequence.", "Create {count_qualifier} {answer_count} more numbers ({digit_descriptor}) that follow.",
    "Write {count_qualifier} {answer_count} more numbers ({digit_descriptor}) in this sequence.", "Generate {count_qualifier} {answer_count} additional numbers ({digit_descriptor}) to extend this sequence", "Generate {count_qualifier} {answer_count} additional numbers ({digit_descriptor}).", "Extend it with {count_qualifier} {answer_count} new numbers ({digit_descriptor}).",
    "Continue the sequence with {count_qualifier} {answer_count} more numbers ({digit_descriptor})", "Create {count_qualifier} {answer_count} more numbers ({digit_descriptor}) to extend the sequence",
]
CLOSINGS = [
    "Say only the numbers - nothing more.", "Please just say the numbers, nothing more.", "Give me just the numbers, no explanation needed.", "Return the numbers exactly as requested, nothing else.",
    "Simply provide the numbers in the specified format.", "Respond with only the numbers, no additional text.", "No explanation, just the numbers.", "Just the numbers, please.", "Provide only the numerical values.",
    "Output nothing but the numbers.", "No commentary, just numbers.", "Skip any explanation and give only numbers.", "Nothing but numbers in your response.", "Only the numerical sequence, nothing else.", "Just show me the numbers.",
    "Answer with numbers alone.", "Reply with only numerical values.", "No words, just numbers.", "Don't add any text - numbers only.",
]


def number_prompts(spark: SparkSession, size: int, seed: int = 0, examples: tuple[int, int] = (3, 9), values: tuple[int, int] = (100, 1000), answers: int = 10, digits: int = 3) -> DataFrame:
    """(row_idx, prompt) of `size` number prompts; both ranges exclude their upper ends. Each choice is a hash of
    (seed, row, choice), so a row doesn't depend on how the rows are partitioned."""

    def pick(name: str, n: int, i: Column | None = None) -> Column:
        key = F.col("row_idx") if i is None else F.concat_ws("-", F.col("row_idx").cast("string"), i.cast("string"))
        return uniform(f"{seed}:{name}", key, F.lit(n)).cast("int")

    def choice(name: str, options: list[str]) -> Column:
        return F.array(*[F.lit(o) for o in options])[pick(name, len(options))]

    count = pick("count", examples[1] - examples[0]) + examples[0]
    shown = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: (pick("value", values[1] - values[0], i) + values[0]).cast("string")), ", ")
    qualified = F.replace(F.replace(F.replace(choice("instruction", INSTRUCTIONS), F.lit("{count_qualifier}"), choice("qualifier", QUALIFIERS)), F.lit("{answer_count}"), F.lit(str(answers))), F.lit("{digit_descriptor}"), choice("digits", [d.format(max_digits=digits) for d in DIGITS]))
    prompt = F.concat_ws(" ", F.replace(choice("opening", OPENINGS), F.lit("{examples}"), shown), qualified, choice("format", sorted(STYLE)), choice("closing", CLOSINGS))
    return spark.range(size).select(F.col("id").alias("row_idx")).select("row_idx", prompt.alias("prompt"))
