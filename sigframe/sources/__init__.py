"""Sources and sinks: named-table catalogue, archive listing, stand-in inputs."""
