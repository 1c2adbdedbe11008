"""Where text comes from: directory trees, tables, registries and manifests."""

from .corpus import Corpus, read_corpus, scan_corpus
from .filters import (
    exclude_basenames,
    filter_ext,
    filter_ignored,
    glob_regex,
    ignore_regex,
    large_files,
    path_ignored,
    read_text,
)
from .registry import present_projects, read_projects, read_secret_rules, select_projects
from .tables import files_from, spread_small, write_tree

__all__ = [
    "Corpus", "exclude_basenames", "files_from", "filter_ext", "filter_ignored",
    "glob_regex", "ignore_regex", "large_files", "path_ignored", "present_projects",
    "read_corpus", "read_projects", "read_secret_rules", "read_text", "scan_corpus",
    "select_projects", "spread_small", "write_tree",
]
