"""Run parameters with the defaults of the corpus and duplicate pipelines."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CorpusConfig:
    expected_documents: int = 1059
    min_segment_words: int = 8
    close_reading_min_words: int = 30
    close_reading_max_words: int = 320
    candidate_limit: int = 60
    token_limit: int = 5000
    ngram_limit: int = 500
    collocation_limit: int = 500
    collocation_min_count: int = 5
    tfidf_features: int = 5000
    tfidf_min_df: int = 2
    tfidf_max_df: float = 0.9
    tfidf_per_document: int = 20
    tfidf_per_group: int = 25
    token_budget: int = 32_000


@dataclass(frozen=True)
class DuplicateConfig:
    threshold: float = 0.90
    simhash_max_distance: int = 24
    prefilter: bool = False


#: The stop words of the token statistics.
STOPWORDS = (
    "the", "and", "or", "of", "to", "in", "for", "with", "a", "an", "is", "are", "you", "we", "your", "our", "this",
    "that", "these", "those", "be", "as", "by", "on", "at", "from", "it", "its", "they", "their", "not", "may", "will",
    "can",
)
#: The names of the ten dictionary groups, in the order of the feature columns.
GROUPS = (
    "documentary_transparency", "algorithmic_practice", "data_disclosure", "procedure", "actor_forum", "consequence",
    "contestability", "algorithmic_opacity", "boilerplate_consent", "contextual_integrity",
)
#: A small dictionary of the engine's own; a user passes their own terms as a table (group, ord, term).
TEST_DICTIONARY = {
    "documentary_transparency": ["ranking", "recommendation signals", "advertising", "automated filter", " rank "],
    "algorithmic_practice": ["ranking", "recommendation signals", "advertising", "automated filter", " rank "],
    "data_disclosure": ["location history", "contact lists", "crash reports", "session tokens", "lists"],
    "procedure": ["appeals panel", "requests", "support portal", "procedure"],
    "actor_forum": ["ombuds office", "regional regulator", "seller council", "office"],
    "consequence": ["warning", "temporary lock", "removal of the listing"],
    "contestability": ["review", "mediator", "dispute", "contested"],
    "algorithmic_opacity": ["statistical purposes", "routine maintenance", "might"],
    "boilerplate_consent": ["by using", "you accept", "opt-out"],
    "contextual_integrity": ["child", "minors", "parent or guardian"],
}
