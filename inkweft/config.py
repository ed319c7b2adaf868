"""Settings of a document base."""

from __future__ import annotations

from dataclasses import dataclass, field

from inkweft.functions.language import stem_length, stopwords


@dataclass(frozen=True)
class Settings:
    languages: tuple[str, ...] = ("en",)
    internal_hosts: tuple[str, ...] = ()
    extra_stopwords: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    #: Letters of further languages and how they are written in Latin letters.
    letters: tuple[tuple[str, str], ...] = ()
    # fragments
    chunk_chars: int = 420
    chunk_overlap: float = 0.25
    # search
    default_hits: int = 8
    per_hit_chars: int = 620
    total_chars: int = 6000
    heading_weight: float = 2.0
    density_weight: float = 0.4
    title_in_sections: bool = False
    near_copy: float = 0.8
    # doubt
    low_confidence: float = 0.9
    always_doubt_below: float = 0.8
    close_race: float = 1.15
    sentence_lead: float = 1.5
    same_passage: float = 0.9
    copy_share: float = 0.4
    copy_sample: int = 40
    min_passage: int = 20
    # gates
    suspicious_source_bytes: int = 8192
    minimum_body_chars: int = 200
    run_on_share: float = 0.05
    min_image_bytes: int = 8000
    # reports
    history_limit: int = 10
    map_document_limit: int = 40
    map_section_limit: int = 30
    missing_limit: int = 40
    own_stem_length: int | None = field(default=None)

    @property
    def stem_length(self) -> int:
        return self.own_stem_length or stem_length(list(self.languages))

    @property
    def stopwords(self) -> list[str]:
        return sorted({*stopwords(list(self.languages)), *self.extra_stopwords})

    @property
    def overlap_chars(self) -> int:
        return int(self.chunk_chars * self.chunk_overlap)


#: The languages of the test tables.
FOUR = Settings(languages=("en", "uk", "de", "fr"))
