"""The chunk, the row that everything works on, and fixed limits."""

from pyspark.sql import types as T

CHUNK = T.StructType(
    [
        *(T.StructField(n, T.StringType(), False) for n in ("chunk_id", "repository_id", "file_path", "language", "symbol_name", "symbol_type")),
        T.StructField("start_line", T.IntegerType(), False),
        T.StructField("end_line", T.IntegerType(), False),
        T.StructField("code", T.StringType(), False),
        T.StructField("docstring", T.StringType()),
        T.StructField("imports", T.ArrayType(T.StringType())),
        T.StructField("calls", T.ArrayType(T.StringType())),
        *(T.StructField(n, T.StringType()) for n in ("class_name", "parent_symbol", "version_id", "version_label", "commit_hash")),
    ]
)

# File types by language, folders that are never entered, and the size limit.
LANGUAGES = {
    ".py": "Python",
    ".js": "JavaScript",
    ".jsx": "JavaScript",
    ".mjs": "JavaScript",
    ".cjs": "JavaScript",
    ".ts": "TypeScript",
    ".tsx": "TypeScript",
    ".java": "Java",
    ".c": "C++",
    ".cc": "C++",
    ".cpp": "C++",
    ".cxx": "C++",
    ".h": "C++",
    ".hh": "C++",
    ".hpp": "C++",
    ".hxx": "C++",
}
IGNORED_FOLDERS = (
    ".git", ".hg", ".svn", ".idea", ".vscode", "node_modules", "__pycache__", ".venv", "venv", "env",
    "build", "dist", "target", "coverage", ".next", ".nuxt", "vendor", "out",
)
MAX_FILE_BYTES = 1_000_000

# What callers may ask for.
LIMITS = {
    "query": (1, 4000),
    "top_k": (1, 100),
    "candidate_k": (1, 500),
    "seed_k": (1, 100),
    "context_candidate_k": (1, 250),
    "max_graph_hops": (1, 8),
    "per_version_top_k": (1, 100),
    "candidate_pool_size": (1, 500),
    "min_similarity": (0.0, 1.0),
    "max_tracks": (1, 500),
}


def checked(name: str, value):
    """``value`` if it is within the limits of ``name``; a query is stripped first."""
    low, high = LIMITS[name]
    value = value.strip() if isinstance(value, str) else value
    size = len(value) if isinstance(value, str) else value
    if not low <= size <= high:
        raise ValueError(f"{name} must be from {low} to {high}")
    return value


def not_negative(**values) -> None:
    for name, value in values.items():
        if value < 0:
            raise ValueError(f"{name} must not be negative")
