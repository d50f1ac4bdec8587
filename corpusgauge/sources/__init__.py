"""Readers, writers and the bindings from the fixture tables to engine inputs."""
