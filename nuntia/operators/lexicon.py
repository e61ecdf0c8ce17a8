"""Which words make a notice relevant: term, anchor, exclusion and rejection patterns."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from nuntia.functions.text import java, plain

# Fixed values. Patterns are data: they are matched as written, after accents are stripped from pattern and text.
TERMS = (
    "informátic[ao]s?",
    r"sistemas?\s+(?:y\s+)?(?:redes|microinformátic|comunicaciones)",
    "telecomunicaciones?",
    r"\btic\b",
    r"ingenier[oa]\s+(?:de\s+)?(?:software|informátic[ao]|telecomunicac|sistemas)",
    "programador[a]?",
    "desarrollador[a]?",
    "ciberseguridad",
    r"tecnolog[ií]as?\s+(?:de\s+la\s+)?informaci[oó]n",
    r"auxiliar\s+t[eé]cnico\s+inform[aá]tico",
    r"inteligencia\s+artificial",
    r"\bia\b",
    r"ingenier[ií]a?\s+de\s+datos",
    r"ciencia\s+de\s+datos",
    r"cient[ií]fico[as]?\s+de\s+datos",
    r"analista\s+de\s+datos",
    r"administrador[as]?\s+de\s+bases?\s+de\s+datos",
    r"\bdata\s+(?:engineer|scientist|analyst|architecture|lake|warehouse)\b",
    r"big\s+data",
    r"machine\s+learning",
    r"aprendizaje\s+autom[aá]tico",
    r"deep\s+learning",
)
ANCHORS = (
    "plaza",
    "convocatoria",
    "bases",
    r"bolsa\s+de\s+empleo",
    r"bolsa\s+de\s+trabajo",
    "oposici[oó]n",
    r"personal\s+laboral",
    "selecci[oó]n",
    "contrataci[oó]n",
    r"bolsa\s+de\s+reserva",
    r"bolsa\s+extraordinaria",
)
EXCLUSIONS = (
    r"aplicaci[oó]n\s+inform[aá]tica",
    r"aplicaciones\s+inform[aá]ticas",
    r"medios\s+inform[aá]ticos",
    r"recursos\s+inform[aá]ticos",
    r"herramientas?\s+inform[aá]ticas?",
    r"plataformas?\s+inform[aá]ticas?",
    r"incidencias\s+inform[aá]ticas?",
    r"soportes?\s+inform[aá]ticos?",
)
REJECT_ALWAYS = ("formativ[oa]s?", r"formativ\.")
REJECT_UNLESS_TERM = ("mantenimiento", "bomber[oa]s?")
ENGLISH_TERMS = (
    r"\bSoftware Engineer\b",
    r"\bSoftware Developer\b",
    r"\bApplications Developer\b",
    r"\bApplications Architect\b",
    r"\bFull-Stack\b",
    r"\bFull\s+Stack\s+Developer\b",
    r"\bBackend Developer\b",
    r"\bFrontend Developer\b",
    r"\bCloud Architect\b",
    r"\bCloud Engineer\b",
    r"\bDevOps Engineer\b",
    r"\bDevOps Specialist\b",
    r"\bSystem Administrator\b",
    r"\bSystems Administrator\b",
    r"\bInfrastructure Engineer\b",
    r"\bNetwork Engineer\b",
    r"\bNetwork Specialist\b",
    r"\bData Scientist\b",
    r"\bData Analyst\b",
    r"\bData Engineer\b",
    r"\bDatabase Administrator\b",
    r"\bDBA\b",
    r"\bICT Expert\b",
    r"\bICT Specialist\b",
    r"\bInformation Systems Officer\b",
    r"\bSolution Architect\b",
    r"\bEnterprise Architect\b",
    r"\bCybersecurity Specialist\b",
    r"\bInformation Security Officer\b",
)
#: Titles of state notices with one of these words are of no interest.
REJECTED_WORDS = ("policia local", "bomberos", "guardia civil", "letrados", "jueces", "auxilio judicial", "cuerpo administrativo", "medicos", "enfermeros")
#: Keys of a lexicon file.
FILE_KEYS = {"terms": "it_keywords", "anchors": "contest_anchors", "exclusions": "boilerplate_exclusions", "reject_always": "title_reject_absolute", "reject_unless_term": "title_reject_relative"}


@dataclass(frozen=True)
class Lexicon:
    """Patterns as written; the methods below give them in the form in which Spark matches them."""

    terms: tuple[str, ...] = TERMS
    anchors: tuple[str, ...] = ANCHORS
    exclusions: tuple[str, ...] = EXCLUSIONS
    reject_always: tuple[str, ...] = REJECT_ALWAYS
    reject_unless_term: tuple[str, ...] = REJECT_UNLESS_TERM
    english_terms: tuple[str, ...] = ENGLISH_TERMS

    @classmethod
    def load(cls, path: str | Path | None = None) -> Lexicon:
        """From a YAML file; keys that it lacks are empty. Without a file the built-in lexicon, with a warning if one was named."""
        if path is None:
            return cls()
        if not Path(path).exists():
            warnings.warn(f"no lexicon file {path}: the built-in lexicon is used", stacklevel=2)
            return cls()
        import yaml

        found = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        return cls(**{field: tuple(found.get(key) or ()) for field, key in FILE_KEYS.items()})

    def folded(self, field: str) -> list[str]:
        """Patterns of a field for accent-stripped text."""
        return [java(plain(p)) for p in getattr(self, field)]

    def raw(self, field: str) -> list[str]:
        """Patterns of a field for text as it is."""
        return [java(p) for p in getattr(self, field)]

    def table(self, spark: SparkSession) -> DataFrame:
        """All patterns as rows: kind, ord, pattern."""
        rows = [(k, i, p) for k in (*FILE_KEYS, "english_terms") for i, p in enumerate(getattr(self, k))]
        return spark.createDataFrame(rows, "kind string, ord int, pattern string")


def either(patterns: list[str]) -> str:
    """One pattern for all; it matches nothing if there are none."""
    return "|".join(f"(?:{p})" for p in patterns) or r"(?!)"
