"""Operators over files tables; each returns a lazy DataFrame."""

from .ages import drift, drift_rows, stale
from .clients import client_files, sprawl, sprawl_global, wrapper_global, wrappers
from .dependencies import (
    advisory_table,
    js_deps,
    js_manifest,
    lockfile_check,
    manifest_findings,
    mismatch_versions,
    missing_key,
    pre_release,
    py_requirements,
    tracked_versions,
    unpinned,
    version_mismatch,
    vulnerable,
)
from .duplicates import (
    duplicate_findings,
    duplicate_groups,
    duplicate_sites,
    js_functions,
    py_functions,
    text_blocks,
)
from .extract import with_quarantine
from .layout import (
    missing_counterpart,
    missing_entries,
    missing_manifest,
    root_files,
    root_flags,
    unindexed_fks,
)
from .lines import (
    downgrade,
    drop_comments,
    first_match_scan,
    line_scan,
    lines,
    prefix_scan,
    secret_scan,
)
from .multiline import absent_within, loop_scan, multiline_scan
from .usage import exports_of, imports_of, unused_exports, unused_functions, unused_imports

__all__ = [name for name in dir() if not name.startswith("_")]
