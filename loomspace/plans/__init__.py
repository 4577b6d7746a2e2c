"""Helpers around plans: sessions, table access, materialisation and plan inspection."""
