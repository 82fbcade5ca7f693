"""Where pipelines write."""
