"""Fixed values of the data model: label classes, edge classes, path rules, weights and limits."""

#: Edge types that a change travels along, against the edge's direction.
IMPACT_EDGE_TYPES = ("CALLS", "IMPORTS", "EXTENDS", "INHERITS", "IMPLEMENTS", "HAS_METHOD", "HAS_PROPERTY", "MEMBER_OF", "READS", "WRITES", "ACCESSES", "OVERRIDES", "METHOD_OVERRIDES", "METHOD_IMPLEMENTS", "HTTP_CALLS", "ACCESSES_RESOURCE", "FETCHES")
#: Labels of nodes that define a name.
DEFINITION_LABELS = ("Function", "Method", "Class", "Interface", "Struct", "Enum", "Trait", "Route", "GraphQL", "Tool", "Command", "Config", "Job", "Table", "Repository", "Migration", "Cache", "Event", "Policy", "Resource", "Transaction")
#: Labels that search treats as symbols, as primary symbols, and as containers.
SYMBOL_LABELS = ("Function", "Method", "Class", "Interface", "Struct", "Enum", "Trait", "Type", "Const", "Variable", "Route", "Tool", "Command", "Config", "Job", "Table", "Repository", "Migration", "Cache", "Event", "Policy", "Resource", "Transaction", "GraphQL")
PRIMARY_LABELS = ("Function", "Method", "Class", "Interface", "Struct", "Enum", "Trait", "Type", "Route", "Tool", "Command", "Config", "Job", "Table", "Repository", "Migration", "Cache", "Event", "Topic", "Policy", "Transaction", "GraphQL")
CONTAINER_LABELS = ("File", "Folder", "Project", "Package", "Module", "Community", "Process")
#: Labels whose properties are searchable text.
SEMANTIC_LABELS = ("Process", "Route", "Tool", "Command", "Config", "Job", "Table", "Repository", "Migration", "Cache", "Event", "Topic", "Policy", "Community", "Resource", "Transaction", "GraphQL")
#: String properties, and array properties, of that text, in order.
TEXT_PROPS = ("name", "summary", "processType", "commandType", "key", "configType", "configSource", "valueHint", "jobType", "schedule", "handlerName", "method", "description", "toolSource", "operationName", "operationType", "graphqlSource", "strategy", "tableName", "tableSource", "entityName", "repositorySource", "migrationType", "migrationSource", "version", "backend", "cacheSource", "bus", "eventSource", "broker", "topicSource", "policyType", "policySource", "url", "resourceType", "resourceSource", "route", "tool")
ARRAY_PROPS = ("trace", "steps", "sources", "columns", "tables", "operations", "responseKeys", "errorKeys", "middleware", "consumerGroups")
#: Labels that clusters don't count as symbols.
NOT_CLUSTER_SYMBOLS = ("Community", "File", "Folder", "Project", "Directory", "Module", "Package")
#: Path segments, and endings, of generated or foreign files.
NOISY_SEGMENTS = (".git", "node_modules", "vendor", "vendors", "dist", "build", "target", "coverage", "__pycache__", ".venv", "venv", ".next", ".nuxt", ".turbo", "generated", "gen", "third_party", "third-party")
NOISY_ENDINGS = (".min.js", ".min.css", ".json", ".jsonl", ".lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "composer.lock", "cargo.lock", "go.sum", "tokenizer.json", "vocab.json", "merges.txt")
#: Paths that name no file, and file names without a dot that do.
NO_FILES = (".", "/", "(root)", "src", "lib", "app", "apps")
BARE_FILES = ("BUILD", "WORKSPACE", "BUCK", "Makefile", "Dockerfile", "Containerfile")
#: Words that don't tell clusters apart: as labels, as path parts, as name tokens.
GENERIC_LABELS = ("(root)", "root", "src", "source", "app", "apps", "lib", "libs", "core", "module", "modules", "package", "packages", "community", "cluster", "group")
GENERIC_PATH_PARTS = ("", ".", "src", "source", "app", "apps", "lib", "libs", "components", "component", "pages", "page", "routes", "route", "models", "model", "utils", "util", "helpers", "helper", "index", "mod", "main", "types", "type")
GENERIC_TOKENS = ("get", "set", "new", "run", "main", "init", "load", "save", "read", "write", "build", "create", "update", "delete", "remove", "handle", "process", "data", "node", "nodes", "edge", "edges", "file", "files", "type", "types", "item", "items", "value", "values")
#: Edge types of the maps.
ROUTE_HANDLERS, ROUTE_CONSUMERS = ("HANDLES_ROUTE",), ("FETCHES", "HTTP_CALLS")
TOPIC_PRODUCERS, TOPIC_CONSUMERS = ("PUBLISHES_TOPIC", "EMITS"), ("CONSUMES_TOPIC", "LISTENS_ON")
#: Query words that bring others with them.
SYNONYMS = {"jwt": ("token", "claims"), "authentication": ("token", "security", "credential", "login"), "auth": ("token", "security", "credential", "login"), "authenticate": ("token", "security", "credential", "login"), "authorization": ("permission", "role", "scope"), "authorize": ("permission", "role", "scope")}
#: Search weights.
NAME_BOOST, SYMBOL_BOOST, EXACT_BOOST, COVERAGE_BOOST, LABEL_BOOST, CONTAINER_PENALTY, NOISY_PENALTY = 3.0, 1.20, 2.40, 1.45, 1.35, 0.45, 0.35
FUZZY_WORDS, FUZZY_CHARS = 3, 3
RRF_K = 60
#: Symbol weights in clusters.
CLUSTER_WEIGHTS = {22: ("Process",), 18: ("Class", "Interface", "Struct", "Enum", "Trait", "Type"), 14: ("Function", "Method", "Route", "Tool", "Command", "Config", "Job", "Table", "Repository", "Migration", "Cache", "Event", "Policy", "Transaction")}
GOLDEN_ANGLE = 2.399963229728653
SPACING, PACK, RING = 10.0, 2.0, 100.0
#: Limits of requests: (default, most).
QUERY_LIMIT, REFS_LIMIT, IMPACT_DEPTH, IMPACT_LIMIT, CONTEXT_LINES, PROCESS_SYMBOLS, HIT_PROCESSES, NEIGHBOR_CAP, SLICE_LINES = (10, 100), 25, (2, 10), 50, (1, 5), (10, 200), 3, 200, 2000
RENDER_BUDGET, EGO_DEPTH, EGO_NODES = (50_000, 1_000, 500_000), (2, 8), 2_000
