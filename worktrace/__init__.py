"""worktrace: work-log analytics as Spark DataFrame operators."""
