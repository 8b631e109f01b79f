"""The three path filters.  They differ on purpose: what is indexed, searched and watched are three sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.paths import EXTENSIONS, base_name, extension, parts
from ..functions.text import col

#: Folder in which the engine keeps its own state.
STATE_DIR = ".corpusloom"
# Names without an extension that are taken as text.
PLAIN_NAMES = "Dockerfile dockerfile Containerfile Makefile makefile justfile Procfile Brewfile Vagrantfile Jenkinsfile Tiltfile README LICENSE".split()
# Folders and extensions of each filter.
INDEX_SKIPPED = [".git", STATE_DIR, *"node_modules vendor .venv __pycache__ dist build .next target .ssh .aws __snapshots__".split()]
SEARCH_SKIPPED = [".git", STATE_DIR, *"node_modules vendor dist build target __snapshots__ snapshots".split()]
WATCH_SKIPPED = [".git", "node_modules", "target", "dist", ".ssh", STATE_DIR, "__snapshots__", "snapshots"]
INDEX_EXTENSIONS = [*EXTENSIONS, "md", "txt"]
SEARCH_EXTENSIONS = "js jsx ts tsx rs py java go c h cpp hpp cs php rb swift kt kts scala html css scss json yaml yml toml xml sql sh md txt".split()
WATCH_EXTENSIONS = [*EXTENSIONS, "md", "html", "txt"]
SCHEMA_SKIPPED = ".git .hg .svn node_modules target dist build .next .nuxt .cache .idea .vscode vendor coverage".split()
HIDDEN_KEPT = (".github", ".vscode")


def is_generated_page(path) -> Column:
    """Below docs/wiki."""
    return col(path).rlike(r"(^|/)docs/wiki(/|$)")


def _plain(path) -> Column:
    return extension(path).isNull() & base_name(path).isin(*PLAIN_NAMES)


def _any_part(path, names, hidden: bool) -> Column:
    def bad(x):
        out = x.isin(*names)
        return out | (F.startswith(x, F.lit(".")) & ~x.isin(*HIDDEN_KEPT)) if hidden else out

    return F.exists(parts(path), bad)


def _ends(path, names) -> Column:
    out, name = F.lit(False), base_name(path)
    for n in names:
        out = out | F.endswith(name, F.lit(n))
    return out


def index_ignores(path) -> Column:
    name = base_name(path)
    odd = name.isin(".DS_Store", "Thumbs.db", ".npmrc") | F.startswith(name, F.lit(".env")) | _ends(path, ("_snapshot.json", ".snap", ".key", ".pem", ".p12", ".o", ".so"))
    return is_generated_page(path) | _any_part(path, INDEX_SKIPPED, True) | odd


def search_ignores(path) -> Column:
    name = base_name(path)
    return _any_part(path, SEARCH_SKIPPED, True) | F.startswith(name, F.lit(".env")) | _ends(path, ("_snapshot.json", ".snap", ".key", ".pem", ".p12"))


def watch_ignores(path) -> Column:
    name = base_name(path)
    return is_generated_page(path) | _any_part(path, WATCH_SKIPPED, False) | (name == ".DS_Store") | F.startswith(name, F.lit(".env")) | _ends(path, ("_snapshot.json", ".snap"))


def _has(path, extensions) -> Column:
    return F.coalesce(extension(path).isin(*extensions), F.lit(False)) | _plain(path)


def is_indexable(path) -> Column:
    return _has(path, INDEX_EXTENSIONS) & ~index_ignores(path)


def is_searchable(path) -> Column:
    return _has(path, SEARCH_EXTENSIONS) & ~search_ignores(path)


def is_watched(path) -> Column:
    return _has(path, WATCH_EXTENSIONS) & ~watch_ignores(path)


def is_graph_source(path) -> Column:
    return F.coalesce(extension(path).isin(*EXTENSIONS), F.lit(False))


def schema_skips(path) -> Column:
    return F.exists(parts(path), lambda x: F.lower(x).isin(*SCHEMA_SKIPPED))


def is_sql_schema(path) -> Column:
    name, low = F.lower(base_name(path)), F.lower(F.concat(F.lit("/"), col(path)))
    said = F.contains(name, F.lit("schema")) | F.contains(name, F.lit("migration")) | F.contains(name, F.lit("init"))
    below = F.contains(low, F.lit("/migrations/")) | F.contains(low, F.lit("/database/")) | F.contains(low, F.lit("/db/"))
    return F.endswith(name, F.lit(".sql")) & (said | below)


def is_model(path) -> Column:
    name, low = F.lower(base_name(path)), F.lower(F.concat(F.lit("/"), col(path)))
    script = F.endswith(name, F.lit(".ts")) | F.endswith(name, F.lit(".js"))
    return F.endswith(name, F.lit(".model.ts")) | F.endswith(name, F.lit(".model.js")) | (F.contains(low, F.lit("/database/")) & script)


def is_provider_hint(path) -> Column:
    name = F.lower(base_name(path))
    return (name == ".env") | F.startswith(name, F.lit(".env.")) | name.isin("application.yml", "application.yaml", "application.properties", "docker-compose.yml", "docker-compose.yaml")
