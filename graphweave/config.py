"""Settings of scanning, answering and the change feed. Word lists and limits are fixed values the answers depend on."""

NODE_TYPES = ("FILE", "MODULE", "CLASS", "FUNCTION", "METHOD", "VARIABLE", "TYPE")
EDGE_TYPES = ("DEFINES", "IMPORTS", "CALLS", "INHERITS", "CONTAINS", "USES", "EXPORTS")
# Extensions with a parser, and what a repository scan leaves out.
EXTENSIONS = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript"}
IGNORED_FOLDERS = (
    "node_modules", ".git", "__pycache__", ".venv", "venv", "env",
    "dist", "build", ".next", ".nuxt", "coverage", ".pytest_cache",
    ".mypy_cache", ".ruff_cache", "target", "out", ".idea", ".vscode",
)
IGNORED_FILES = ("*.min.js", "*.min.css", "*.map", "*.lock", "package-lock.json", "yarn.lock", "poetry.lock")

# Extensions and folders of the wider walk, which only counts languages.
WIDE_EXTENSIONS = {
    "py": "python", "ts": "typescript", "js": "javascript", "go": "go", "rs": "rust", "java": "java", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp",
    "cs": "csharp", "php": "php", "rb": "ruby", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "sh": "bash", "bash": "bash", "zsh": "bash",
    "fish": "bash", "ps1": "powershell", "psm1": "powershell", "fs": "fsharp", "fsi": "fsharp", "fsx": "fsharp", "jsx": "javascript", "tsx": "typescript",
}
WIDE_IGNORED_FOLDERS = (".git", "node_modules", "venv", ".venv", "__pycache__", "build", "dist", "target", "out", "bin", "obj", ".env")

MAX_FILE_BYTES = 512 * 1024
MAX_ROWS = 20
SNIPPET_CHARS = 2_000
TOKENS_PER_ANSWER = 400
DEBOUNCE_MS = 300
EMBEDDING_MODEL = "code-mini-384"
