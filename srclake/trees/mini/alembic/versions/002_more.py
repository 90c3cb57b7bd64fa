"""more"""
revision: str = "002"
down_revision: str = "001"


def upgrade():
    op.add_column("users")
