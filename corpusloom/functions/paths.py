"""Path functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Extension to language name.
LANGUAGES = {
    "javascript": ("js", "mjs", "cjs"),
    "jsx": ("jsx",),
    "typescript": ("ts", "mts", "cts"),
    "tsx": ("tsx",),
    "python": ("py",),
    "rust": ("rs",),
    "go": ("go",),
    "java": ("java",),
    "kotlin": ("kt", "kts"),
    "c": ("c", "h"),
    "cpp": ("cpp", "hpp"),
    "csharp": ("cs",),
    "php": ("php",),
    "ruby": ("rb",),
    "swift": ("swift",),
    "shell": ("sh", "bash", "zsh", "fish"),
    "sql": ("sql",),
    "json": ("json", "jsonc"),
    "yaml": ("yaml", "yml"),
    "toml": ("toml",),
    "xml": ("xml",),
    "css": ("css",),
    "scss": ("scss",),
    "less": ("less",),
    "vue": ("vue",),
    "svelte": ("svelte",),
    "astro": ("astro",),
    "ini": ("ini", "cfg", "conf"),
}
EXTENSIONS = {e: language for language, names in LANGUAGES.items() for e in names}


def parts(path) -> Column:
    return F.split(col(path), "/")


def base_name(path) -> Column:
    return F.element_at(parts(path), -1)


def extension(path) -> Column:
    """What follows the last dot of the name; null for none and for names whose only dot comes first."""
    name = base_name(path)
    # . ends at line ends, which the name's start must not have before its last dot
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.substring_index(name, ".", -1))


def stem(path) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def parent(path) -> Column:
    return F.when(F.contains(col(path), F.lit("/")), F.regexp_replace(col(path), r"/[^/]*$", "")).otherwise("")


def language(path) -> Column:
    """Language of a path by its extension, or null: one lookup, so that the extension is cut out once."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair]), extension(path))


def document_kind(path) -> Column:
    return F.when(extension(path) == "md", "wiki").otherwise("code")


def normalize(path, root: str = "") -> Column:
    """Relative to root, with . and .. resolved; leading .. stay."""
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    if root:
        p = F.when(F.startswith(p, F.lit(root.rstrip("/") + "/")), F.substring(p, len(root.rstrip("/")) + 2, 1 << 20)).otherwise(p)
    kept = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("..")) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(
            F.concat(acc, F.array(x))
        ),
    )
    return F.array_join(folded, "/")


def ancestors(path) -> Column:
    """Folders above a path, outermost first."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def page_file_name(path) -> Column:
    """Name of a path's generated page: other signs as _, then 8 hex digits of its digest."""
    safe = F.regexp_replace(col(path), r"[^\p{IsAlphabetic}\p{N}._-]", "_")
    return F.concat(safe, F.lit("_"), F.substring(F.sha2(col(path), 256), 1, 8), F.lit(".md"))


def page_label(path) -> Column:
    """Short label of a page: slashes as _."""
    return F.concat(F.regexp_replace(col(path), r"[\\/]", "_"), F.lit(".md"))


def short_label(path, most: int = 52, keep: int = 49) -> Column:
    p = col(path)
    return F.when(F.length(p) > most, F.concat(F.lit("..."), F.substring(p, -keep, keep))).otherwise(p)


def line_label(path, start, end) -> Column:
    """path, path:L5 or path:L5-L9."""
    p, s, e = col(path), col(start), col(end)
    return (
        F.when(s.isNull() | e.isNull(), p)
        .when(s == e, F.concat(p, F.lit(":L"), s.cast("string")))
        .otherwise(F.concat(p, F.lit(":L"), s.cast("string"), F.lit("-L"), e.cast("string")))
    )


# Words of a path that hint at its purpose, in order.
PURPOSES = (
    (("workflow", "github"), "Automation / CI behavior"),
    (("test",), "Validation and quality checks"),
    (("component",), "UI rendering and interaction"),
    (("parser", "index"), "Code intelligence and indexing"),
)
GENERAL_PURPOSE = "General project logic"


def purpose(path) -> Column:
    """What a file is likely for, by the first hint in its path."""
    return first_hint(F.lower(col(path)), PURPOSES, GENERAL_PURPOSE)


def first_hint(text: Column, hints, otherwise: str) -> Column:
    """Label of the first hint any of whose words stands in text."""
    out = F.lit(otherwise)
    for words, label in reversed(hints):
        out = F.when(contains_any(text, words), label).otherwise(out)
    return out


def contains_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit
