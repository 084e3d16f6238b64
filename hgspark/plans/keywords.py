"""Keywords of a question."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import KEYWORD_TEMPERATURE
from ..functions.word_lists import STOPWORDS
from ..sources.providers import LLMProvider, ProviderError

PROMPT = "You list the keywords of a question: names, terms and things it is about. Answer with JSON of the form {\"keywords\": [\"...\"]} and nothing else."


def simple_keywords(query: Column) -> Column:
    """Lower-case words of more than two characters that aren't stopwords, and runs of capitalised words (these
    whatever their length, and stopwords too), sorted."""
    words = F.filter(F.split(F.lower(query), r"[^\p{L}\p{M}\p{N}]+"), lambda w: (F.length(w) > 2) & ~w.isin(sorted(STOPWORDS)))
    runs = F.transform(F.regexp_extract_all(query, F.lit(r"(\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b)"), F.lit(1)), F.lower)
    return F.array_sort(F.array_distinct(F.concat(words, runs)))


def clean_keywords(keywords: Column) -> Column:
    """Trimmed, lower-case, longer than one character, each once in order."""
    neat = F.transform(keywords, lambda k: F.lower(F.regexp_replace(k, r"(?U)^\s+|\s+$", "")))
    return F.array_distinct(F.filter(neat, lambda k: F.length(k) > 1))


def _clean(keywords: list[str]) -> list[str]:
    return list(dict.fromkeys(k for w in keywords if len(k := w.strip().lower()) > 1))


def llm_keywords(provider: LLMProvider, question: str, prompt: str = PROMPT, model: str | None = None) -> list[str]:
    found = provider.generate(prompt, question, model, KEYWORD_TEMPERATURE)
    if not isinstance(found, dict) or not isinstance(found.get("keywords"), list):
        raise ProviderError("no keywords in the answer")
    return _clean([str(k) for k in found["keywords"]])


def keywords_with_fallback(spark, provider: LLMProvider, question: str, **options) -> list[str]:
    """The model's keywords, or the simple ones where it fails."""
    try:
        return llm_keywords(provider, question, **options)
    except (ProviderError, ValueError):
        return keywords_of(spark, question)


def keywords_of(spark, question: str) -> list[str]:
    return spark.createDataFrame([(question,)], "q string").select(simple_keywords(F.col("q"))).first()[0]
