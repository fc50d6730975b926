"""Column functions over texts: JSON out of replies, verdicts, scores, fingerprints, snippets, costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Variables that must not be left in a prompt, and words that a prompt is tested for.
TEMPLATE_VARIABLES = ["system_name", "problem_statement", "perspective", "previous_design", "review", "designs", "round", "position", "own_design", "other_designs", "design_text", "debate_history", "task_context"]
DESIGN_WORDS = ["api", "database", "component", "service", "architecture", "scalability", "interface", "endpoint", "schema", "module", "microservice"]
PERSPECTIVE_WORDS = ["perspective", "role", "focus", "expertise", "viewpoint", "lens", "angle", "standpoint", "advocate", "critic"]
#: Patterns of a score in prose, in the order they are tried.
SCORE_PATTERNS = [r"(?i)(?:overall|total|final)\s*(?:score|rating)?:?\s*(\d+(?:\.\d+)?)\s*(?:/\s*10)?", r"(?i)(\d+(?:\.\d+)?)\s*/\s*10", r"(?i)score[:\s]+(\d+(?:\.\d+)?)"]

#: Patterns of a verdict, of a status, and of a block of JSON between fences.
VERDICT_PATTERN = r"(?i)VERDICT:\s*(ACCEPT|REJECT)"
STATUS_PATTERN = r"(?i)STATUS:\s*(CONVERGED|NOT_CONVERGED)"
FENCE_PATTERN = r"(?s)```(?:json)?\s*\n(.*?)\n```"


def json_text(reply: Column) -> Column:
    """The JSON object in a reply: the whole, else a fenced block, else from the first { to the last }; null if none parses."""
    fenced = F.nullif(F.regexp_extract(reply, FENCE_PATTERN, 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))
    good = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(good(F.trim(reply)), good(fenced), good(braces))


def verdict(reply: Column) -> Column:
    """accept or reject; without a verdict, reject."""
    return F.when(F.lower(F.regexp_extract(reply, VERDICT_PATTERN, 1)) == "accept", "accept").otherwise("reject")


def convergence_status(reply: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(reply, STATUS_PATTERN, 1)), F.lit(""))


def without_status(reply: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(reply, STATUS_PATTERN, ""), r"^\s+|\s+$", "")


def quick_score(reply: Column) -> tuple[Column, Column]:
    """The score in a reply (10 at most; 5.0 if there is none), and whether one was found."""
    inner = F.nullif(F.regexp_extract(reply, r'(\{[^}]*"overall_score"[^}]*\})', 1), F.lit(""))
    tries = [F.get_json_object(inner, "$.overall_score").try_cast("double")]
    tries += [F.nullif(F.regexp_extract(reply, p, 1), F.lit("")).try_cast("double") for p in SCORE_PATTERNS]
    found = F.coalesce(tries[0], F.when(F.coalesce(*tries[1:]).isNotNull(), F.least(F.coalesce(*tries[1:]), F.lit(10.0))))
    return F.coalesce(found, F.lit(5.0)), found.isNotNull()


def contradiction(reply: Column) -> Column:
    """The `contradicts` field of a reply's JSON, else whether the word stands in it."""
    return F.coalesce(F.get_json_object(json_text(reply), "$.contradicts").try_cast("boolean"), reply.rlike("(?i)CONTRADICTS"))


def left_variables(prompt: Column) -> Column:
    """Sorted names of template variables left in a prompt."""
    pattern = r"\{\{\s*(" + "|".join(TEMPLATE_VARIABLES) + r")\s*\}\}"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(prompt, F.lit(pattern), F.lit(1))))


def short_id(column: Column) -> Column:
    return F.substring_index(column, "_", 1)


def snippet(text: Column, start: int, stop: int) -> Column:
    """Characters start to stop (from 0, end left out)."""
    return F.substring(text, start + 1, stop - start)


def fingerprint(*texts: Column) -> Column:
    """20 hex digits of the SHA-256 of the texts joined by "||", without what is not ASCII."""
    return F.substring(F.sha2(F.regexp_replace(F.concat_ws("||", *texts), r"[^\x00-\x7F]", "").cast("binary"), 256), 1, 20)


def prompt_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def call_cost(tokens_in: Column, cached: Column, tokens_out: Column, price_in: Column, price_cached: Column, price_out: Column, batch: Column | None = None, discount: Column | None = None, clamp: bool = False) -> Column:
    """Dollars of a call, prices per million tokens. clamp: more cached than read tokens count as none read."""
    fresh = tokens_in - cached
    fresh = F.greatest(fresh, F.lit(0)) if clamp else fresh
    cost = (fresh * price_in + cached * price_cached + tokens_out * price_out) / 1_000_000
    return cost * F.when(batch, 1 - discount).otherwise(F.lit(1.0)) if batch is not None else cost


def limit_message(tokens: Column, cost: Column, max_tokens: float, max_cost: float) -> Column:
    """exceeded_tokens, exceeded_cost, near (80% of a limit or more), or ok."""
    return F.when(tokens > max_tokens, "exceeded_tokens").when(cost > max_cost, "exceeded_cost").when((tokens >= 0.8 * max_tokens) | (cost >= 0.8 * max_cost), "near").otherwise("ok")


def bullets(items: Column, numbered: bool = False) -> Column:
    line = (lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)) if numbered else (lambda x, i: F.concat(F.lit("- "), x))
    return F.array_join(F.transform(items, line), "\n")


def iso_micros(text: Column) -> Column:
    """Microseconds of an ISO timestamp, null if it can't be parsed."""
    return F.unix_micros(F.try_to_timestamp(text))


def section_pairs(own: Column, rubric: Column) -> Column:
    """Pairs of the evaluator, else of the rubric; entries of less than two are dropped."""
    return F.filter(F.coalesce(F.when(F.size(own) > 0, own), rubric, F.array().cast("array<array<string>>")), lambda p: F.size(p) >= 2)


def normal_pair(text: Column) -> Column:
    """Section pairs with one separator."""
    return F.regexp_replace(text, r"\s*(?:\||<->)\s*", "|")
