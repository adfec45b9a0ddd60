"""Prompt and target text, token budget, batched model scoring.

Prompts are built with native string and array expressions.  A model is a
plug-in: :func:`score_batches` feeds Arrow batches of one column to a Python
callable in each worker (loaded once per worker), the only place Python
touches rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import col_
from ..functions.text import token_count

# ---------------------------------------------------------------------------
# The instruction text must equal the reference's prompt for the
# same model behaviour.  Placeholders: title, text, the per-currency question
# block.
# ---------------------------------------------------------------------------
QUESTION = "appreciation, depreciation, or unchanged"

PROMPT_INSTRUCTIONS = (
    "Instructions:\n"
    "Objective: For each mentioned currency, answer the following questions:\n"
    "- What has been the current/past movement of the currency (appreciation, depreciation, or unchanged)?\n"
    "- What is the future expectation for the currency (appreciation, depreciation, or unchanged)?\n\n"
    "You must answer these two questions for each of the following currencies mentioned in the article:\n"
)

PROMPT_TAIL = (
    "\n\n"
    "Output Format:\n"
    "- Important: Provide your answer in separate rows for each currency as shown above.\n"
    "- Do not combine multiple currencies in the same row.\n"
    '- Each currency should have its own line with "_past" or "_future" specified.\n\n'
    "Example:\n"
    '- If the article states, "The EUR is expected to appreciate," the output should be:\n'
    '    EUR_past: "unchanged",\n'
    '    EUR_future: "appreciation"\n'
    '- If the article states, "EUR/USD depreciated last week," the output should be:\n'
    '    EUR_past: "depreciation",\n'
    '    USD_past: "appreciation"\n'
    '- If only future movements are mentioned for a currency, the past movement should be labelled as '
    '"unchanged" and vice versa.\n\n'
    "Currency Pair Interpretation:\n"
    "- If currencies are discussed in pairs, interpret as follows:\n"
    '    - If "EUR/USD appreciated," label EUR_past as "appreciation" and USD_past as "depreciation".\n'
    '    - If "EUR/USD depreciated," label EUR_past as "depreciation" and USD_past as "appreciation".\n\n'
    "Synonyms:\n"
    "- Recognize the following synonyms for each currency:\n"
    "- **EUR**: EUR, Euro\n"
    "- **USD**: USD, Dollar, Dollars, US Dollar, US-Dollar, U.S. Dollar, US Dollars, US-Dollars, "
    "U.S. Dollars, Greenback\n"
    "- **JPY**: JPY, Yen, Japanese Yen\n"
    "- **GBP**: GBP, Pound, Pounds, Sterling, British Pound, British Pounds\n"
    "- **AUD**: AUD, Australian Dollar, Australian Dollars, Aussie\n"
    "- **CAD**: CAD, Canadian Dollar, Canadian Dollars\n"
    "- **CHF**: CHF, Swiss Franc, Swiss Francs, Swissie\n"
    "- **NZD**: NZD, New Zealand Dollar, New Zealand Dollars, Kiwi\n"
    "- **NOK**: NOK, Norwegian Krone, Norwegian Kroner\n"
    "- **SEK**: SEK, Swedish Krona, Swedish Kronor\n\n"
    "Answer below in the given format:\n"
)

MAX_ARTICLE_TOKENS = 7192
MAX_SEQ_LENGTH = 8192


def question_block(currencies) -> Column:
    """``C_past: "<question>"`` and ``C_future: ...`` lines joined by ',\\n' (no trailing comma)."""
    lines = F.transform(col_(currencies), lambda c: F.array(
        F.concat(c, F.lit(f'_past: "{QUESTION}"')), F.concat(c, F.lit(f'_future: "{QUESTION}"'))))
    return F.array_join(F.flatten(lines), ",\n")


def build_prompt(title, text, currencies) -> Column:
    """The user prompt of the reference for one article."""
    return F.concat(F.lit("Title: "), F.coalesce(col_(title), F.lit("")), F.lit("\nText: "),
                    F.coalesce(col_(text), F.lit("")), F.lit("\n\n" + PROMPT_INSTRUCTIONS),
                    F.coalesce(question_block(currencies), F.lit("")), F.lit(PROMPT_TAIL))


def label_map(codes: Sequence[str], horizons: Sequence[str] = ("past", "future"),
              fmt: str = "{code}_{horizon}_label") -> Column:
    """map<'<CCY>_<horizon>', label> from wide label columns."""
    kv = []
    for c in codes:
        for h in horizons:
            kv += [F.lit(f"{c}_{h}"), F.col(f"`{fmt.format(code=c, horizon=h)}`")]
    return F.create_map(*kv)


def target_text(currencies, labels) -> Column:
    """Expected answer: ``C_past: "label"`` / ``C_future: "label"`` per mentioned currency."""
    lab = lambda c, h: F.coalesce(F.try_element_at(col_(labels), F.concat(c, F.lit(h))),
                                  F.lit("unchanged"))
    parts = F.transform(col_(currencies), lambda c: F.concat(
        c, F.lit('_past: "'), lab(c, "_past"), F.lit('"\n'),
        c, F.lit('_future: "'), lab(c, "_future"), F.lit('"\n')))
    return F.array_join(parts, "")


def messages(prompt, answer=None) -> Column:
    """Chat message array ``[{role, content}]`` (user, optionally assistant)."""
    items = [F.struct(F.lit("user").alias("role"), col_(prompt).alias("content"))]
    if answer is not None:
        items.append(F.struct(F.lit("assistant").alias("role"), col_(answer).alias("content")))
    return F.array(*items)


def inst_wrap(prompt) -> Column:
    """``[INST] ... [/INST]`` wrapper used by instruction-tuned models without a chat template."""
    return F.concat(F.lit("<s>[INST] "), col_(prompt), F.lit(" [/INST]"))


def prompt_overhead(currencies, budget: int = MAX_SEQ_LENGTH, with_target: bool = True) -> tuple[Column, Column]:
    """Tokens used by the prompt around an empty article, and what remains of ``budget``."""
    p = build_prompt(F.lit(""), F.lit(""), currencies)
    if with_target:
        empty = F.create_map().cast("map<string,string>")
        p = F.concat(p, target_text(currencies, empty))
    n = token_count(p)
    return n, F.lit(budget) - n


_SCORERS: dict = {}


def worker_scorer(factory: Callable):
    """The Python worker's scorer of an importable factory, loaded at its first use."""
    import sys

    own = getattr(sys.modules.get(getattr(factory, "__module__", "")), getattr(factory, "__qualname__", ""), None)
    if own is not factory:
        return factory()
    if factory not in _SCORERS:
        _SCORERS[factory] = factory()
    return _SCORERS[factory]


def overhead_table(spark, codes: Sequence[str], counts: Sequence[int] = (1, 2, 3, 5, 10), budget: int = MAX_SEQ_LENGTH) -> DataFrame:
    """``n_currencies, overhead_tokens, remaining_tokens`` of prompts that ask for the first n codes."""
    n, left = prompt_overhead(F.col("cur"), budget)
    rows = spark.createDataFrame([(list(codes[:k]),) for k in counts], "cur array<string>")
    return rows.select(F.size("cur").alias("n_currencies"), n.alias("overhead_tokens"), left.alias("remaining_tokens"))


def score_batches(df: DataFrame, scorer_factory: Callable[[], Callable[[list[str]], list[str]]],
                  input_col: str, output_col: str = "response", batch_size: int = 16) -> DataFrame:
    """Run a model over one text column in Arrow batches.

    ``scorer_factory`` loads the model; one that can be imported by its name is called
    once per Python worker, any other once per task.  The scorer maps a list of inputs to a list of outputs of equal
    length.  Batches are cut to ``batch_size`` rows.
    """
    import pandas as pd

    from pyspark.sql.types import StringType, StructField, StructType

    out_schema = StructType([*df.schema.fields, StructField(output_col, StringType(), True)])

    def run(batches: Iterable[pd.DataFrame]):
        scorer = worker_scorer(scorer_factory)
        for pdf in batches:
            outs = []
            texts = pdf[input_col].fillna("").tolist()
            for i in range(0, len(texts), batch_size):
                outs.extend(scorer(texts[i:i + batch_size]))
            yield pdf.assign(**{output_col: outs})

    return df.mapInPandas(run, out_schema)
