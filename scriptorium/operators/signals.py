"""The fourteen signals of machine-like writing, and the estimate made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import text as T

#: Key, weight, label and description of each signal.
SIGNALS = [
    ("generic_phrases", 0.14, "Frases genéricas / vacías", "Frases que suenan académicas pero aportan poco contenido."),
    ("connector_overuse", 0.10, "Exceso de conectores", "Uso muy frecuente de conectores ('además', 'por lo tanto'...)."),
    ("connector_openers", 0.09, "Oraciones que abren con conector", "Muchas frases empiezan con 'Además', 'Por otro lado', etc."),
    ("uniformity", 0.08, "Uniformidad de oraciones", "Las oraciones tienen longitudes muy parecidas entre sí."),
    ("low_burstiness", 0.06, "Ritmo plano", "Falta la alternancia natural entre frases cortas y largas."),
    ("repetition", 0.07, "Repetición de ideas", "Se repiten secuencias de palabras o ideas similares."),
    ("repetitive_openings", 0.08, "Aperturas repetitivas", "Las oraciones empiezan una y otra vez con las mismas palabras."),
    ("low_lexical_diversity", 0.08, "Vocabulario poco variado", "Se reutilizan las mismas palabras; poca riqueza léxica."),
    ("hedging", 0.07, "Exceso de cautela / generalidades", "Abundan atenuadores prudentes ('suele', 'en general', 'podría')."),
    ("uniform_paragraphs", 0.05, "Párrafos de tamaño uniforme", "Los párrafos tienen longitudes llamativamente parejas."),
    ("list_structure", 0.05, "Estructura de listas", "Mucho contenido en viñetas o enumeraciones, típico de respuestas de IA."),
    ("too_clean", 0.05, "Redacción demasiado 'limpia'", "Ausencia casi total de marcas informales o errores humanos."),
    ("typographic_polish", 0.04, "Tipografía 'pulida'", "Uso de rayas y comillas curvas que rara vez teclea una persona."),
    ("low_personal_voice", 0.04, "Poca voz personal", "Casi no aparece opinión o experiencia en primera persona."),
]

#: The feature that a signal rises with (or, with ``True``, falls with) and where its ramp begins and ends.
RAMPS = {
    "generic_phrases": ("generic_phrase_density", 0.3, 2.5, False),
    "connector_overuse": ("connector_density", 3.0, 10.0, False),
    "connector_openers": ("sentence_opener_ratio", 0.10, 0.45, False),
    "uniformity": ("sentence_len_std", 2.0, 9.0, True),
    "low_burstiness": ("sentence_len_cv", 0.20, 0.60, True),
    "repetition": ("repeated_trigram_ratio", 0.02, 0.15, False),
    "repetitive_openings": ("sentence_start_diversity", 0.45, 0.85, True),
    "low_lexical_diversity": ("mattr", 0.60, 0.85, True),
    "hedging": ("hedging_density", 1.0, 4.0, False),
    "uniform_paragraphs": ("paragraph_len_cv", 0.15, 0.60, True),
    "list_structure": ("list_marker_ratio", 0.10, 0.50, False),
    "too_clean": ("punct_ratio", 0.05, 0.18, False),
    "typographic_polish": ("typographic_density", 0.30, 2.0, False),
    "low_personal_voice": ("personal_voice_density", 0.3, 3.0, True),
}


#: The features and counts that the signals take.
USED = {feature for feature, *_ in RAMPS.values()} | {"paragraph_count", "informal_density", "word_count"}


def value(key: str, f: Column) -> Column:
    """A signal's strength from 0 to 1, of a struct of features."""
    feature, lo, hi, falls = RAMPS[key]
    up = T.ramp(f[feature], lo, hi)
    out = F.lit(1.0) - up if falls else up
    if key == "uniform_paragraphs":
        return F.when(f["paragraph_count"] < 3, F.lit(0.0)).otherwise(out)
    if key == "too_clean":
        return F.when(f["informal_density"] == 0, out).otherwise(F.lit(0.0))
    return out


def heuristic(f: Column, digits: int | None = None) -> Column:
    """Weighted sum of the signals; ``digits``: each is rounded before."""
    out = F.lit(0.0)
    for key, weight, _, _ in SIGNALS:
        v = value(key, f)
        out = out + F.lit(weight) * (T.rounded(v, digits) if digits else v)
    return T.clamp(out, 0.0, 1.0)


def severity(v: Column) -> Column:
    return F.when(v >= 0.66, "alta").when(v >= 0.33, "media").otherwise("baja")


def level(score: Column) -> Column:
    """How a whole-number score is shown."""
    return F.when(score >= 66, "alto").when(score >= 33, "medio").otherwise("bajo")


def breakdown(f: Column) -> Column:
    """Array of the signals with value, score, weight, severity and words for people."""
    rows = []
    for key, weight, label, description in SIGNALS:
        v = T.rounded(value(key, f))
        rows.append(F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), v.alias("value"), T.percent(v).alias("score"), F.lit(weight).alias("weight"), severity(v).alias("severity"), F.lit(description).alias("description")))
    return F.array(*rows)


def effective_weight(h: Column, weight: float = 0.5) -> Column:
    """The model's weight; less where the signals are weak."""
    return F.when(h >= 0.35, F.lit(weight)).otherwise(F.lit(weight) * h / F.lit(0.35))


def combined(h: Column, model: Column | None = None, weight: float = 0.5) -> Column:
    """Signals and model; without a model's probability the signals alone."""
    if model is None:
        return h
    w = effective_weight(h, weight)
    return F.when(model.isNull(), h).otherwise(w * model + (F.lit(1.0) - w) * h)


def probability(f: Column, model: Column | None = None, weight: float = 0.5, calibration: dict | None = None) -> Column:
    """The estimate as a whole percentage between 3 and 97."""
    p = combined(heuristic(f, 4), model, weight)
    if calibration:
        p = T.platt(p, calibration["a"], calibration["b"])
    return T.percent(T.clamp(p, 0.03, 0.97))
