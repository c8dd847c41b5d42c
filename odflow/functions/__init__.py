"""Part of odflow."""
