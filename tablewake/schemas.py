"""Declared schemas of landed inventory files and of the catalog tables (DDL strings).

JSON columns hold JSON text.
"""

from __future__ import annotations

# Columns of the landed inventory.
INVENTORY = {
    "databases": """name string, arn string, catalog_id string, description string,
        location_uri string, create_time timestamp""",
    "tables": """name string, database_name string, catalog_id string, description string,
        owner string, table_type string, created_by string, version_id string, retention bigint,
        is_registered_with_lake_formation boolean, create_time timestamp, update_time timestamp,
        last_access_time timestamp, last_analyzed_time timestamp, view_original_text string,
        view_expanded_text string, parameters string, partition_keys string,
        storage_descriptor string, federated_table string, target_table string, lf_tags string""",
    "glue_jobs": """name string, arn string, description string, role string,
        created_on timestamp, last_modified_on timestamp, glue_version string,
        execution_class string, worker_type string, number_of_workers bigint,
        max_capacity double, max_retries bigint, timeout bigint, log_uri string,
        security_configuration string, command string, connections string,
        default_arguments string, non_overridable_arguments string, execution_property string,
        notification_property string, job_bookmark string, source_control_details string,
        tags string""",
    "lambda_functions": """name string, arn string, description string, role string,
        runtime string, handler string, code_sha_256 string, code_size bigint,
        last_modified timestamp, version string, package_type string, state string,
        last_update_status string, revision_id string, memory_size bigint, timeout string,
        reserved_concurrent_executions bigint, kms_key_arn string,
        dead_letter_config_target_arn string, vpc_id string, architectures string, code string,
        environment_variables string, ephemeral_storage string, layers string,
        logging_config string, snap_start string, tracing_config string, url_config string,
        vpc_security_group_ids string, vpc_subnet_ids string, tags string""",
    "events": """event_id string, event_name string, event_source string,
        event_time timestamp, username string, region string, cloud_trail_event string""",
}

# Columns packed into a job's attributes document, per job type.
JOB_ATTRIBUTES = {
    "glue": (
        "command", "default_arguments", "non_overridable_arguments", "connections",
        "glue_version", "execution_class", "worker_type", "number_of_workers", "max_capacity",
        "max_retries", "timeout", "tags",
    ),
    "lambda": (
        "handler", "code_sha_256", "code_size", "version", "package_type", "state",
        "memory_size", "timeout", "architectures", "environment_variables", "layers",
        "ephemeral_storage", "vpc_id", "vpc_security_group_ids", "vpc_subnet_ids",
        "tracing_config", "logging_config", "url_config", "tags",
    ),
}

# Those of the attribute columns that hold JSON.
JSON_COLUMNS = frozenset(
    (
        "command", "connections", "default_arguments", "non_overridable_arguments",
        "execution_property", "notification_property", "job_bookmark", "source_control_details",
        "tags", "architectures", "code", "environment_variables", "ephemeral_storage", "layers",
        "logging_config", "snap_start", "tracing_config", "url_config",
        "vpc_security_group_ids", "vpc_subnet_ids",
    )
)

CATALOG = {
    "databases": f"id string, {INVENTORY['databases']}",
    "tables": f"id string, {INVENTORY['tables']}",
    "jobs": """id string, type string, name string, description string, role string,
        runtime string, last_modified timestamp, attributes string""",
    "job_artifacts": "job_id string, reference string",
    "job_extractions": """job_id string, cache_key string, model string,
        prompt_version string, extraction string, extracted_at timestamp""",
    "job_table_edges": """job_id string, database_name string, table_name string,
        direction string, is_dynamic boolean, evidence string""",
    "table_join_edges": """job_id string, left_database string, left_table string,
        left_column string, right_database string, right_table string, right_column string,
        evidence string""",
}

AUDIT_LOG = """event_id string, database_name string, table_name string, event_name string,
    event_time timestamp, username string, region string, flagged boolean,
    reported_at timestamp"""

SOURCE_FILES = "job_id string, path string, contents string"
