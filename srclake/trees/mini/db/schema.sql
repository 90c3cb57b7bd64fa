CREATE TABLE users (id int);
create unique index users_id on users (id);
CREATE OR REPLACE VIEW v_users AS SELECT * FROM users;
