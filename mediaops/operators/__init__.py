"""DataFrame -> DataFrame operators on media, segment, detection and entity tables."""
