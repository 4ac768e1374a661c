"""Parameters of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

#: English function words. A longer list can be given to EngineConfig or read by sources.dump.read_stop_words.
STOP_WORDS = tuple(
    """a about above after again all also am an and any are as at be because been before being below between both but by
    can could did do does doing down during each few for from further had has have having he her here hers him his how i if
    in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so
    some such than that the their them then there these they this those through to too under until up very was we were what
    when where which while who whom why will with would you your""".split()
)


@dataclass(frozen=True)
class EngineConfig:
    stop_words: tuple[str, ...] = field(default=STOP_WORDS, repr=False)
    title_letters: int = 63
    body_letters: int = 64
    high_from: int = 8
    title_weight: int = 100
    category_weight: int = 30
    most_list_weight: int = 100
    results: int = 10
    damping: float = 0.85
    stop_residual: float = 1e-12
    #: Words are stemmed with steps 2 and 4 as well.
    full_stemmer: bool = False
    #: An unknown query word becomes the next word of the dictionary by its number, as a lower-bound search would find it.
    lower_bound: bool = False
    #: With lower_bound: a query word that would become the first word of the dictionary is dropped from the query.
    drop_first_word: bool = False
    #: t: and c: restrict a query word to title, and to title and category postings.
    enforce_fields: bool = False
    #: Postings of low frequency take part in the search.
    include_low: bool = False
    #: Titles and link targets are matched by their base-38 number instead of the lower-case text.
    match_by_number: bool = False


DEFAULT = EngineConfig()
