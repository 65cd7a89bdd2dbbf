"""Training-data operators on whole tables; nothing outside this subpackage imports it."""
