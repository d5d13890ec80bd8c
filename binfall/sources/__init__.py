from .recordings import Recordings, form_schema, from_json, read_recordings, recorded_columns, to_json, write_recordings

__all__ = ["Recordings", "form_schema", "from_json", "read_recordings", "recorded_columns", "to_json", "write_recordings"]
