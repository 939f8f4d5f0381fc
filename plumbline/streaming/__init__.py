"""Landing of uploads as a stream."""
