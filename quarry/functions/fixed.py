"""Word lists, patterns and weights that results depend on."""

# Words that carry no signal in code searches.
STOP_TOKENS = """
and as async await break case catch class const continue def else elif enum except false final finally fn for from
func function if impl import in interface is let match namespace new nil none not null or package pass private
protected public raise return self static struct switch this throw throws true try type using var void where while with
""".split()

# Head word: words a query for it may also mean.
SYNONYMS = {
    "delete": "remove evict purge clear destroy discard erase",
    "remove": "delete evict purge clear destroy discard erase",
    "evict": "delete remove purge clear discard",
    "purge": "delete remove evict clear discard",
    "destroy": "delete remove terminate close shutdown kill",
    "create": "build make new init setup generate produce",
    "build": "create make new init setup generate",
    "init": "create build setup initialize start begin",
    "initialize": "create build setup init start begin",
    "start": "init begin launch run execute",
    "stop": "close shutdown terminate kill halt",
    "close": "stop shutdown terminate finalize",
    "shutdown": "stop close terminate kill",
    "fetch": "get retrieve load read query",
    "get": "fetch retrieve load read query",
    "retrieve": "fetch get load read query",
    "load": "fetch get retrieve read",
    "save": "write store persist insert update",
    "store": "save write persist insert",
    "persist": "save write store insert",
    "write": "save store persist insert",
    "add": "insert push append put",
    "insert": "add push append put",
    "push": "add insert append",
    "append": "add insert push",
    "put": "add insert set",
    "error": "fail failure exception panic err warn warning",
    "fail": "error failure exception panic err",
    "failure": "error fail exception panic err",
    "err": "error fail failure exception panic",
    "warn": "warning error",
    "warning": "warn error",
    "timeout": "deadline expiry expiration ttl",
    "expiry": "timeout deadline expiration ttl",
    "expiration": "timeout deadline expiry ttl",
    "ttl": "timeout deadline expiry expiration",
    "auth": "login signin authenticate authorize token session",
    "login": "auth signin authenticate",
    "signin": "auth login authenticate",
    "authenticate": "auth login signin authorize",
    "authorize": "auth authenticate permission allow",
}

# Other names of languages.
LANGUAGE_ALIASES = {
    "assembly": "asm", "bash": "sh", "c#": "cs", "c++": "cpp", "clojure": "clj", "cplusplus": "cpp", "csharp": "cs", "css3": "css",
    "docker": "dockerfile", "ecmascript": "js", "elixir": "ex", "erlang": "erl", "f#": "fs", "fsharp": "fs", "golang": "go",
    "graphqlschema": "graphql", "haskell": "hs", "html5": "html", "javascript": "js", "javascriptreact": "jsx", "julia": "jl",
    "kotlin": "kt", "matlab": "m", "markdown": "md", "node": "js", "nodejs": "js", "objectivec": "m", "objectivecpp": "mm",
    "objc": "m", "objc++": "mm", "perl": "pl", "postgres": "sql", "postgresql": "sql", "protobuf": "proto",
    "protocolbuffers": "proto", "python": "py", "powershell": "ps1", "rstats": "r", "ruby": "rb", "rust": "rs", "shell": "sh",
    "sqlite": "sql", "terraform": "tf", "typescript": "ts", "typescriptreact": "tsx", "visualbasic": "vb", "vbnet": "vb",
    "yaml": "yaml", "yml": "yaml",
}

# Languages of files that go by name.
SPECIAL_FILES = {
    "build": "starlark", "build.bazel": "starlark", "cmakelists.txt": "cmake", "containerfile": "dockerfile", "dockerfile": "dockerfile",
    "gemfile": "rb", "gnumakefile": "makefile", "jenkinsfile": "groovy", "justfile": "makefile", "makefile": "makefile",
    "module.bazel": "starlark", "package.json": "json", "rakefile": "rb", "tiltfile": "starlark", "vagrantfile": "rb",
    "workspace": "starlark", "workspace.bazel": "starlark",
}

LANGUAGE_GROUPS = {
    "backend": "go java js kt php py rb rs scala ts",
    "config": "dockerfile hcl json jsonc makefile tf toml yaml",
    "frontend": "astro css html js jsx less mdx sass scss svelte ts tsx vue",
    "mobile": "dart java kt swift",
    "popular": "c cpp cs css go html java js kt php py rb rs sql swift ts",
    "systems": "asm c cpp go rs zig",
    "web": "astro css html js jsx less php sass scss svelte ts tsx vue",
}

# Words that mark feedback as negative.
NEGATIVE_WORDS = "bad broken crap dumb failed failing failure garbage hate incorrect regression stupid trash useless wrong".split()

# Path segments that say nothing about a file.
GENERIC_SEGMENTS = "src internal pkg tests test dist build".split()
# Query words that ask for tests, documents, workflows.
WANTS_TESTS = "test tests testing spec benchmark benchmarks".split()
WANTS_DOCS = "readme docs doc documentation install setup contributing security changelog".split()
WANTS_WORKFLOWS = "github actions workflow workflows ci release yaml yml".split()
DECLARATION_STARTS = ["async def ", "def ", "class ", "func ", "function ", "public ", "private ", "protected ", "static ", "final "]
# What a line that brings in another file begins with.
IMPORT_STARTS = ["import ", "from ", "using ", "use ", "require ", "require(", "require_relative ", "#include "]
# Marks of which two make a line look like code.
CODE_MARKS = r"""[(){}\[\].:;=,"'`]"""

# Languages whose calls, and whose imports, are drawn.
WITH_REFERENCES = "go py rb js jsx ts tsx java rs php swift kt".split()
WITH_IMPORTS = "go py rb js jsx ts tsx mjs cjs java kt kts rs php swift cs css scss sass less html vue svelte astro".split()
# Languages whose imports name a file if they have a slash, or a dot.
SLASH_IMPORTS = "rb js jsx ts tsx mjs cjs css scss sass less html vue svelte astro php".split()
DOT_IMPORTS = "java kt kts cs swift".split()

# A quoted value of 12 or more characters assigned to a secret's name.
SECRET_ASSIGNMENT = r"""(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*['"][^'"]{12,}"""

BM25_K1, BM25_B, BM25_SCALE = 1.2, 0.75, 0.08
BM25F_SCALE = 0.05
#: Field: weight, length normalisation.
BM25F_FIELDS = {"path": (3.0, 0.20), "topic": (1.4, 0.40), "declarations": (2.5, 0.55), "content": (1.0, 0.75)}
RRF_K, FUSION_TOP, FUSION_SCALE = 60, 5, 0.04
FUSION_WEIGHTS = {"relevance": 1.0, "primary": 0.8, "query_path": 0.35, "bm25": 0.55, "bm25f": 0.45, "structured": 0.45, "structural": 0.65, "proximity": 0.50}
LEXICAL_WEIGHTS = {"jaccard": 0.35, "bm25": 1.3, "bm25f": 1.3}
EXTERNAL_RRF_K = 20
EXACT_SCALE, IDF_BLEND, IDF_CAP = 0.08, 0.12, 1.5
CARD_WEIGHTS = {"symbol": 1.0, "test": 0.95, "usage": 0.72, "import": 0.88, "config": 0.82}
