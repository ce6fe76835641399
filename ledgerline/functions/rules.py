"""Names, lists and thresholds that results depend on."""

from __future__ import annotations

DEFAULT_GROUP = "G-00"
HIGH_CONFIDENCE = 60.0
RESOLVED_STATUSES = ["resolved", "dismissed", "verified clean", "clean", "no match"]

# Display language of a file, by extension.
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".java": "Java",
    ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".c": "C", ".h": "C/C++", ".cs": "C#", ".go": "Go", ".rs": "Rust",
    ".rb": "Ruby", ".php": "PHP", ".swift": "Swift", ".kt": "Kotlin", ".kts": "Kotlin", ".dart": "Dart", ".html": "HTML",
    ".css": "CSS", ".scss": "CSS", ".sql": "SQL", ".sh": "Shell",
}

# Grammar of a file, by extension: a second table with other values.
GRAMMARS = {
    ".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "tsx", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".dart": "dart", ".c": "c",
    ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".go": "go", ".rs": "rust",
    ".rb": "ruby", ".erb": "ruby", ".cs": "csharp", ".swift": "swift", ".scala": "scala", ".sc": "scala", ".sh": "bash",
    ".bash": "bash", ".zsh": "bash", ".lua": "lua", ".php": "php", ".phtml": "php", ".html": "html", ".htm": "html",
    ".css": "css", ".scss": "css", ".sass": "css",
}

# Paths left out when commits are read.
INGEST_IGNORED = r"(?:^|[/\\])(?:node_modules|dist|build|\.next|out|coverage|__pycache__|venv|\.venv|\.pytest_cache|\.gradle|\.cxx|target|bin|obj|\.idea|\.vscode|logs)(?:[/\\]|$)|\.pyc$|(?:^|[/\\])\.DS_Store$"

# Source files that are compared between projects: extensions allowed; directories, names and name patterns left out.
COMPARED_EXTENSIONS = [
    ".py", ".js", ".mjs", ".cjs", ".jsx", ".ts", ".mts", ".cts", ".tsx", ".java", ".kt", ".kts", ".dart", ".c", ".h",
    ".cpp", ".cc", ".cxx", ".hpp", ".hxx", ".go", ".rs", ".cs", ".swift", ".rb", ".erb", ".scala", ".sc", ".lua", ".php",
    ".phtml", ".sh", ".bash", ".zsh", ".html", ".htm", ".css", ".scss", ".sass",
]
EXCLUDED_DIRS = [
    "node_modules", ".git", ".svn", ".hg", "dist", "build", "out", "target", "vendor", "bin", "obj", ".idea", ".vscode",
    "venv", "env", ".venv", "__pycache__", "coverage", "migrations", "static", "public", ".next", ".nuxt", ".svelte-kit",
    "gen", "generated", ".dart_tool", ".flutter-plugins", ".flutter-plugins-dependencies",
]
EXCLUDED_FILES = [
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json", "bun.lockb",
    "composer.json", "composer.lock", "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle",
    "settings.gradle.kts", "mvnw", "mvnw.cmd", "gradlew", "gradlew.bat", "go.mod", "go.sum", "cargo.toml", "cargo.lock",
    "requirements.txt", "pyproject.toml", "pipfile", "pipfile.lock", "setup.py", "setup.cfg", "alembic.ini",
    "poetry.lock", "pubspec.yaml", "pubspec.lock", "gemfile", "gemfile.lock", "dockerfile", "docker-compose.yml",
    "docker-compose.yaml", ".gitignore", ".env", ".env.example", ".env.local", "readme.md", "license", "changelog.md",
    "eslint.config.js", "eslint.config.mjs", "eslint.config.cjs", "prettier.config.js", "prettier.config.mjs",
    "prettier.config.cjs", "next.config.js", "next.config.mjs", "tailwind.config.js", "tailwind.config.ts",
    "postcss.config.js", "postcss.config.cjs", "vite.config.js", "vite.config.ts", "webpack.config.js",
    "babel.config.js", "babel.config.json", "tsconfig.json", "tsconfig.node.json", "jsconfig.json", "angular.json",
    "nest-cli.json", "gatsby-config.js", "remix.config.js", "vite-env.d.ts", "react-app-env.d.ts", "components.json",
]
EXCLUDED_GLOBS = [
    ".eslintrc*", ".prettierrc*", "*.config.*", "*.min.*", "*.bundle.*", "*.map", "*.d.ts", "*.generated.*",
    "*_service_pb2.py", "*.spec.*", "*.test.*", "reportwebvitals.*", "setuptests.*", "serviceworker.*",
    "service-worker.*",
]

# Directories that the inspector of a repository's structure, and the directory tree, pass over.
INSPECTOR_IGNORED = ["node_modules", "__pycache__", "venv", "env", "build", "dist", "target", ".git", ".idea", ".vscode", ".gradle", "ios", "android"]
TREE_IGNORED = [".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", ".next", ".idea", ".vscode", "coverage"]
TEST_DIRS = ["test", "tests", "__tests__", "spec", "specs"]
README_SETUP = "install|setup|run|build|usage|getting started"
README_ARCHITECTURE = "architecture|design|structure|api|component|overview"

# Automation accounts: known names, mail providers of people, and words that mark the rest.
KNOWN_BOTS = "dependabot|github-actions|google-labs-jules|greenkeeper|renovate|snyk-bot|actions-user|npm-owner|railway-app"
PERSONAL_MAIL = r"@(gmail\.com|yahoo\.com|outlook\.com|hotmail\.com|icloud\.com)$"
BOT_WORD = r"(^|[^a-z0-9])(bot|ci|actions|workflow)([^a-z0-9]|$)"

# Similarity of projects.
K, W = 5, 4
MIN_SHARED, PROTECTED_RUN, STOP_SHARE = 10, 10, 0.20
IDENT_OVERLAP = 15.0
