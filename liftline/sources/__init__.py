"""Sources and sinks with declared schemas."""
