"""Keyword presence, keyword counts and technology terms."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms with punctuation, matched anywhere in the text.
PUNCTUATED_TERMS = (
    (".NET", (".net", "dotnet")), ("C#", ("c#", "c-sharp", "csharp")), ("C++", ("c++",)),
    ("ASP.NET", ("asp.net",)), ("Node.js", ("node.js", "nodejs")),
)
# Terms matched as whole words.
WORD_TERMS = (
    ("Python", ("python",)), ("JavaScript", ("javascript",)), ("TypeScript", ("typescript",)),
    ("Java", ("java",)), ("Go", ("golang",)), ("Rust", ("rust",)), ("Ruby", ("ruby",)),
    ("PHP", ("php",)), ("Scala", ("scala",)), ("Kotlin", ("kotlin",)), ("Swift", ("swift",)),
    ("Elixir", ("elixir",)), ("React", ("react",)), ("Angular", ("angular",)), ("Vue", ("vue",)),
    ("Django", ("django",)), ("Flask", ("flask",)), ("FastAPI", ("fastapi",)),
    ("Spring", ("spring",)), ("Rails", ("rails",)), ("AWS", ("aws",)), ("GCP", ("gcp",)),
    ("Azure", ("azure",)), ("Kubernetes", ("kubernetes", "k8s")), ("Docker", ("docker",)),
    ("Terraform", ("terraform",)), ("Kafka", ("kafka",)), ("Spark", ("spark",)),
    ("Airflow", ("airflow",)), ("PostgreSQL", ("postgresql", "postgres")), ("MySQL", ("mysql",)),
    ("MongoDB", ("mongodb",)), ("Redis", ("redis",)), ("Elasticsearch", ("elasticsearch",)),
    ("Snowflake", ("snowflake",)), ("GraphQL", ("graphql",)), ("gRPC", ("grpc",)), ("SQL", ("sql",)),
)
# The language name that is also an English verb.
CASED_TERMS = {"Go": ("golang", r"(?U)(?<![\w-])Go(?![\w-])")}


def quoted(term: str) -> str:
    """``term`` as a literal inside a Java regular expression."""
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def word_pattern(term: str) -> str:
    return f"(?U)\\b{quoted(term)}\\b"


def _hit(text: Column, term: str, mode: str) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.rlike(word_pattern(term)) if mode == "word" else low.contains(term)


def term_present(term: str, title: Column, description: Column, mode: str = "substring",
                 fields: str = "title_and_description") -> Column:
    """Whether ``term`` occurs in the title, or in the title or the description."""
    term = term.strip().lower()
    if not term:
        return F.lit(False)
    hit = _hit(title, term, mode)
    return hit if fields == "title" else hit | _hit(description, term, mode)


def term_count(term: str, title: Column, description: Column, mode: str = "substring",
               fields: str = "title_and_description") -> Column:
    """Non-overlapping occurrences of ``term``, summed over the chosen fields."""
    term = term.strip().lower()
    if not term:
        return F.lit(0)
    pattern = F.lit(word_pattern(term) if mode == "word" else quoted(term))
    texts = [title] if fields == "title" else [title, description]
    counts = [F.regexp_count(F.lower(F.coalesce(t, F.lit(""))), pattern) for t in texts]
    return reduce(lambda a, b: a + b, counts)


def any_term(terms: Sequence[str], text: Column, mode: str = "word") -> Column:
    """Whether any non-blank term occurs in ``text``."""
    terms = [t.strip().lower() for t in terms if t.strip()]
    if not terms:
        return F.lit(False)
    low = F.lower(F.coalesce(text, F.lit("")))
    if mode == "word":
        return low.rlike("(?U)" + "|".join(f"\\b{quoted(t)}\\b" for t in terms))
    return reduce(lambda a, b: a | b, [low.contains(t) for t in terms])


def extract_terms(text: Column, limit: int = 8, punctuated=PUNCTUATED_TERMS, words=WORD_TERMS,
                  cased=CASED_TERMS) -> Column:
    """The first ``limit`` dictionary entries found in ``text``, in dictionary order.

    One regex pass collects every single-word alias; phrases fall back to their own test."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    single = sorted({a for name, aliases in words for a in aliases if name not in cased and a.isalnum()})
    found = F.array_distinct(F.regexp_extract_all(
        low, F.lit("(?U)\\b(" + "|".join(single) + ")\\b"), 1)) if single else F.array().cast("array<string>")

    def build(seen: Column) -> Column:
        picks = [F.when(reduce(lambda a, b: a | b, [low.contains(a) for a in aliases]), F.lit(name))
                 for name, aliases in punctuated]
        for name, aliases in words:
            if name in cased:
                anywhere, pattern = cased[name]
                hit = low.contains(anywhere) | text.rlike(pattern)
            else:
                tests = [F.array_contains(seen, a) if a.isalnum() else low.rlike(word_pattern(a)) for a in aliases]
                hit = reduce(lambda a, b: a | b, tests)
            picks.append(F.when(hit, F.lit(name)))
        return F.slice(F.array_distinct(F.array_compact(F.array(*picks))), 1, limit)

    # transform over a one-element array binds the scan result once for all entries.
    return F.element_at(F.transform(F.array(found), build), 1)
