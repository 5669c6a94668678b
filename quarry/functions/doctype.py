"""Document types: the earliest type word in a text's head, else in its folders' names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD, WS

HEAD_CHARS = 600
UNKNOWN = "unknown"

# Type names and patterns, longer names first.
DOCUMENT_TYPES = (
    ("Должностная инструкция", r"должностн\w*\s+инструкц"),
    ("Служебная записка", r"служебн\w*\s+записк"),
    ("Докладная записка", r"докладн\w*\s+записк"),
    ("Пояснительная записка", r"пояснительн\w*\s+записк"),
    ("Приказ", r"приказ"),
    ("Распоряжение", r"распоряжени"),
    ("Постановление", r"постановлени"),
    ("Решение", r"решени"),
    ("Положение", r"положени"),
    ("Инструкция", r"инструкци"),
    ("Регламент", r"регламент"),
    ("Договор", r"договор"),
    ("Соглашение", r"соглашени"),
    ("Протокол", r"протокол"),
    ("Акт", r"акт(?:а|е|у|ом|ы)?(?!\w)"),
    ("Отчёт", r"отч[её]т"),
    ("Справка", r"справк"),
    ("Заявление", r"заявлени"),
    ("Доверенность", r"доверенност"),
    ("Письмо", r"письм"),
)


def java_pattern(pattern: str) -> str:
    """A dictionary pattern with its classes spelt out."""
    return pattern.replace(r"(?!\w)", f"(?![{WORD}])").replace(r"\w", f"[{WORD}]").replace(r"\s", f"[{WS}]")


def document_type(text: Column, path: Column | None = None, types: tuple[tuple[str, str], ...] = DOCUMENT_TYPES) -> Column:
    """The type of a text with an optional relative path: by head, then by the nearest folder, then 'unknown'."""
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, HEAD_CHARS))
    starts = F.array(*(F.struct(F.regexp_instr(head, F.lit(f"(?<![{WORD}])(?:{java_pattern(p)})")).alias("at"), F.lit(i).alias("no"), F.lit(name).alias("name")) for i, (name, p) in enumerate(types)))
    by_head = F.array_min(F.filter(starts, lambda x: x["at"] > 0))["name"]
    if path is None:
        return F.coalesce(by_head, F.lit(UNKNOWN))
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    folders = F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))

    def named(folder: Column) -> Column:
        return F.coalesce(*(F.when(F.lower(folder).rlike(f"^(?:{java_pattern(p)})"), F.lit(name)) for name, p in types))

    by_folder = F.get(F.filter(F.transform(folders, named), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(by_head, by_folder, F.lit(UNKNOWN))
