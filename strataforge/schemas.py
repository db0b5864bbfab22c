"""Shapes of the code index and the language dimension."""

from __future__ import annotations

#: Languages in order with the extensions of their files; the first to list an extension has it.
LANGUAGES = (
    ("python", "py"), ("go", "go"), ("rust", "rs"), ("javascript", "js jsx mjs cjs"), ("typescript", "ts tsx"), ("java", "java"), ("kotlin", "kt kts"), ("csharp", "cs"),
    ("cpp", "cpp cc cxx hpp hh hxx h"), ("c", "c h"), ("php", "php"), ("dart", "dart"), ("zig", "zig"), ("elixir", "ex exs"), ("ruby", "rb"),
)
LOCATION = "struct<start_line:int,start_column:int,end_line:int,end_column:int>"
FILE = "id bigint, path string, language string, content_hash string, mtime timestamp"
#: What parsing one file gives; error is set instead of symbols if it can't be read.
PARSED = (
    f"path string, error string, functions array<struct<ord:int,class_ord:int,name:string,type:string,location:{LOCATION},parameters:array<struct<name:string,type:string>>,return_type:string,docstring:string,branch_count:int>>, "
    f"classes array<struct<ord:int,parent_ord:int,name:string,location:{LOCATION},base_classes:array<string>,docstring:string>>, variables array<struct<class_ord:int,name:string,type:string,location:{LOCATION}>>, "
    f"dependencies array<struct<dependency_type:string,name:string,function_ord:int,location:{LOCATION}>>"
)


def language_of(extension: str) -> str | None:
    """The first language that lists an extension, in lower case."""
    return next((name for name, ends in LANGUAGES if extension.lower().lstrip(".") in ends.split()), None)


def extensions_of(languages: list[str]) -> set[str]:
    return {e for name, ends in LANGUAGES if name in languages for e in ends.split()}
