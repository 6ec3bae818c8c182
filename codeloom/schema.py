"""The index tables and their vocabularies. Positions are byte offsets, half open."""

from __future__ import annotations

SCHEMA_VERSION = "1.0"

FILES = "path string, hash string, mtime long, indexed_at long"
SYMBOLS = "id string, file string, kind string, name string, start_pos long, end_pos long, qualifier string, visibility string, container string, content_hash string, is_test boolean"
EDGES = "src string, dst string, kind string"
REFERENCES = "file string, start_pos long, end_pos long, symbol_id string"
DEPENDENCIES = "from_file string, to_file string, kind string"
BINDINGS = "file string, local_name string, source_file string, original_name string, import_text string"
SOURCES = "path string, content binary"
META = "key string, value string"

#: Kinds that stand for a type, edges of the type hierarchy.
TYPE_KINDS = ("class", "interface", "struct", "enum", "trait", "object", "type")
HIERARCHY = ("implements", "extends", "trait_impl")
#: Languages by file ending.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "rs": "rust", "py": "python", "pyi": "python",
    "go": "go", "kt": "kotlin", "kts": "kotlin", "java": "java", "cs": "csharp", "rb": "ruby", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp",
    "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "swift": "swift", "php": "php", "scala": "scala",
}
#: Endings that have an extractor, folders that a scan leaves out.
INDEXED = ("ts", "tsx", "rs", "kt", "kts", "cpp", "cc", "cxx", "hpp", "hh", "c", "h", "cs", "py", "pyi", "go", "rb")
SKIPPED_FOLDERS = (".git", "target", "node_modules", "__pycache__", ".venv")
#: Short forms of kinds in outlines.
KIND_SHORT = {"function": "fn", "method": "m", "class": "c", "interface": "i", "struct": "s", "enum": "e", "trait": "t", "const": "const", "namespace": "ns", "type": "ty"}
