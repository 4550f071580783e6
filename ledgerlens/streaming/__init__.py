"""Structured Streaming: message routing (X1), file-drop refresh (X2), running counts."""
