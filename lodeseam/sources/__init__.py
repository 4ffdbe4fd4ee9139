"""Sources and sinks: source trees, Git snapshots, stored indexes."""
