"""init

Create Date: 2024-01-01
"""
revision = "001"
down_revision = None


def upgrade():
    op.create_table("users")
