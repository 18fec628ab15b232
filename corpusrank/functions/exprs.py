"""Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .data import names


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def wiki_link(text: Column) -> Column:
    """Destination title of a link's inner text; null if empty."""
    return F.nullif(F.substring_index(F.substring_index(upper_first(trimmed(text)), "|", 1), "#", 1), F.lit(""))


def hat_destination(text: Column) -> Column:
    """Cleaned destination of a hatnote: cut at ``{{!``; null if empty or with a section."""
    cut = F.substring_index(text, "{{!", 1)
    return F.when((cut != "") & ~F.contains(cut, F.lit("#")), upper_first(cut))


def category_title(text: Column) -> Column:
    return F.translate(text, "_", " ")


def category_name(title: Column, prefix: str = "Category:") -> Column:
    """A category page's title without its prefix."""
    return F.substr(title, F.lit(len(prefix) + 1))


def _is_second_level(domain: Column) -> Column:
    return domain.isin(*sorted(names("second_level_domains")))


def cite_domain(url: Column) -> Column:
    """Registrable domain of a URL without scheme: the last two labels, or three under a known second-level domain; null where labels lack."""
    labels = F.split(F.regexp_extract(url, r"^[^:/]*", 0), r"\.")
    pair = F.concat_ws(".", F.try_element_at(labels, F.lit(-2)), F.try_element_at(labels, F.lit(-1)))
    three = F.concat_ws(".", F.try_element_at(labels, F.lit(-3)), pair)
    return F.when(F.size(labels) >= 2, F.when(_is_second_level(pair), F.when(F.size(labels) >= 3, three)).otherwise(pair))


def without_scheme(url: Column) -> Column:
    return F.regexp_replace(url, r"^https?://", "")


def url_host(url: Column) -> Column:
    """Host of a URL, port included."""
    return F.substring_index(without_scheme(url), "/", 1)


def url_path(url: Column) -> Column:
    """Path of a URL without its leading slash, query and fragment."""
    rest = without_scheme(url)
    path = F.substr(rest, F.locate("/", rest) + 1)
    return F.when(F.locate("/", rest) > 0, F.substring_index(F.substring_index(path, "#", 1), "?", 1)).otherwise("")


def host_domain(host: Column) -> Column:
    """Registrable domain of a host: like :func:`cite_domain`, but a host of two labels passes as it is, and the port stays."""
    last_two, last_three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(_is_second_level(last_two), last_three).otherwise(last_two)


def entity_key(entity_id: Column) -> Column:
    """``Q42`` as one number: the letter above 56 bits, the number below; null if malformed."""
    number = F.regexp_extract(entity_id, r"^[A-Za-z]([0-9]+)$", 1).try_cast("bigint")
    return F.shiftleft(F.ascii(entity_id).cast("bigint"), 56).bitwiseOR(number)


def normalised_words(text: Column) -> Column:
    """Words of a title or sentence: lower case, without brackets and quotation marks, which also separate."""
    return F.filter(F.split(F.lower(text), r"(?U)[\s()\[\]{}<>\"“”„‘’«»]+"), lambda w: w != "")


def normalised_term(text: Column) -> Column:
    return F.array_join(normalised_words(text), " ")


def perplexity(p: Column) -> Column:
    """Aggregate: 2 to the entropy of a distribution; zeros count as none."""
    return F.pow(F.lit(2.0), F.sum(F.when(p > 0, -p * F.log2(p)).otherwise(0.0)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def softmax(scores: Column, temperature: float = 0.5) -> Column:
    """Softmax of an array, its maximum subtracted first, scaled by ``temperature``."""

    def shares(powers: Column) -> Column:
        return bound(F.aggregate(powers, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(powers, lambda x: x / total))

    return bound(scores, lambda s: bound(F.array_max(s), lambda top: bound(F.transform(s, lambda x: F.exp((x - top) * temperature)), shares)))


def noun_mix(score: Column, observations: Column, word: Column, weight: float = 20.0) -> Column:
    """How surely a word is a proper noun: model score and an alphabetic prior; the denominator holds the score, as established."""
    prior = F.rlike(word, F.lit(r"^\p{IsAlphabetic}*$")).cast("double")
    return (score * observations + prior * weight) / (score + weight)


def noun_score(probabilities: Column, observations: Column, word: Column, weight: float = 20.0) -> Column:
    """:func:`noun_mix` of the larger of the proper nouns' probabilities."""
    return bound(bound(probabilities, lambda p: F.greatest(F.element_at(p, 17), F.element_at(p, 18))), lambda score: noun_mix(score, observations, word, weight))


def span_mean(values: Column, pos: Column, width: Column) -> Column:
    """Mean of ``width`` array elements from the 0-based ``pos``."""
    return F.aggregate(F.slice(values, pos + 1, width), F.lit(0.0), lambda a, b: a + b) / width


def any_matches(pattern: str, *columns: str) -> Column:
    """Whether the regex matches any of the columns."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    return found
