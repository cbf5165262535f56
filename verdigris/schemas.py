"""DDL of the relations that operators take and return."""

MEMBERS = "name string, manifest_dir string"
EDGES = "crate string, dep string"
RUNS = "id string, passes bigint, fails bigint"
OUTCOMES = "id string, passed boolean, flaky boolean, duration_ms bigint"
OBSERVED = "id string, ord bigint, at bigint, passed boolean, duration_ms bigint"
HISTORY = "id string, passes bigint, fails bigint, last_fail bigint, last_duration_ms bigint, recent array<boolean>"
GREENS = "crate string, fingerprint string, at bigint"
COVERAGE = "test_id string, file string, line int, base string"
HUNKS = "file string, old_start int, old_count int"
IMPACTS = "file string, whole boolean, line int"
ITEMS = "item_id bigint, name string, kind string, file string, start int, end int, refs array<string>"
ALIASES = "alias string, original string, file string"
METADATA = "packages array<struct<id:string,name:string,manifest_path:string,dependencies:array<struct<name:string>>>>, workspace_members array<string>, workspace_root string"
COVERAGE_EXPORT = "data array<struct<functions:array<struct<filenames:array<string>,regions:array<array<decimal(20,0)>>>>>>"
