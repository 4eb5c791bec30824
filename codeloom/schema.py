"""The engine's tables, labels and relation types."""

from __future__ import annotations

#: Labels and relation types.
LABELS = ("File", "Package", "Class", "Interface", "Method", "Constructor", "Field", "Hook", "Reference")
#: Labels whose nodes get an embedding.
EMBEDDABLE = ("Method", "Class", "Interface", "Constructor")
RELATIONS = ("CONTAINS", "IN_PACKAGE", "HAS_METHOD", "HAS_CONSTRUCTOR", "HAS_FIELD", "DECLARES", "EXTENDS", "IMPLEMENTS", "CALLS", "EXPORTS", "USES_HOOK")
#: Relations that make their source the parent of their target.
STRUCTURAL = ("CONTAINS", "HAS_METHOD", "HAS_CONSTRUCTOR", "HAS_FIELD", "DECLARES")

NODE = (
    "label string, id string, name string, repository string, file_path string, line_number int, line_end int, language string, code string, signature string, "
    "return_type string, docstring string, modifiers array<string>, stereotypes array<string>, properties map<string,string>, content_hash string, embedding array<float>"
)
EDGE = "source_id string, target_id string, rel_type string, properties map<string,string>, file_path string, ordinal int"
FILE = "repository string, file_path string, name string, suffix string, content binary, content_hash string"
STORED_EDGE = "src_label string, source_id string, rel_type string, dst_label string, target_id string, properties map<string,string>"
REPOSITORY = "name string, source string, last_indexed_at timestamp, last_commit_sha string, entity_count long"
