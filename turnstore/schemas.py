"""Table schemas, as DDL. `seq` is the position of a row in its session: a DataFrame has no order of its own."""

SCHEMA_VERSION = 1

USAGE = ["input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"]

MESSAGES = (
    "session_id string, seq long, uuid string, parent_uuid string, type string, role string, model string, timestamp double, "
    "content_text string, content_json string, input_tokens long, output_tokens long, cache_creation_input_tokens long, "
    "cache_read_input_tokens long, embedding array<float>"
)
TOOL_CALLS = (
    "session_id string, seq long, tool_use_id string, message_uuid string, name string, args_json string, result_text string, "
    "result_uuid string, timestamp double, is_error boolean"
)
SESSIONS = "session_id string, model string, created_at double, summary string, cwd string, git_branch string, agent_version string, permission_mode string, session_id_original string"
ARTIFACTS = "session_id string, name string, version long, dtype string, shape array<int>, data binary"
#: Metadata keys with a column of their own; the others go to `extras`, a map from key to JSON value.
INDEXED = {"doc_type": "string", "sqlite_id": "long", "project": "string", "field_type": "string", "created_at_epoch": "long"}
VECTORS = "id string, embedding array<float>, " + ", ".join(f"{k} {t}" for k, t in INDEXED.items()) + ", extras map<string,string>"
